"""What changed between two rounds of a review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_digests(lines: DataFrame, files: DataFrame, include_kind: bool = False) -> DataFrame:
    """(change_id, path, digest) over the contents of all lines of a file in order, whatever their kind and place. Of
    files with the same path the last counts. Files without lines have the digest of nothing."""
    text = F.concat(F.substring("kind", 1, 1), F.col("content")) if include_kind else F.col("content")
    rows = F.array_sort(F.collect_list(F.struct("hunk_idx", "line_idx", text.alias("content"))))
    body = F.array_join(F.transform(rows, lambda x: F.concat(x["content"], F.lit("\n"))), "")
    found = lines.groupBy("change_id", "file_idx").agg(F.sha2(body, 256).alias("digest"))
    named = files.select("change_id", "file_idx", "path").join(found, ["change_id", "file_idx"], "left")
    return named.groupBy("change_id", "path").agg(F.max_by(F.coalesce("digest", F.sha2(F.lit(""), 256)), "file_idx").alias("digest"))


def interdiff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change_id, path, state) of two rounds' digests: new, modified, unchanged or removed."""
    both = before.withColumnRenamed("digest", "old").join(after.withColumnRenamed("digest", "now"), ["change_id", "path"], "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("old") == F.col("now"), "unchanged").otherwise("modified")
    return both.select("change_id", "path", state.alias("state"))


def only_changed(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files that are new or modified since the last round."""
    return files.join(states.filter(F.col("state").isin("new", "modified")), ["change_id", "path"], "left_semi")
