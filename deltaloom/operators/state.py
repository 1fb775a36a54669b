"""Review rounds and notes as tables: each operator returns the table's next state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import note_id


def next_version(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("branch").agg((F.max("version") + 1).alias("next_version"))


def latest_round(rounds: DataFrame) -> DataFrame:
    """The last round of each branch."""
    return rounds.groupBy("branch").agg(F.max_by(F.struct(*[c for c in rounds.columns if c != "branch"]), "version").alias("r")).select("branch", "r.*")


def start_round(rounds: DataFrame, branch: str, sha: str, at: datetime) -> DataFrame:
    """Appends a round with the next version, nothing viewed and no notes."""
    version = rounds.filter(F.col("branch") == branch).agg(F.coalesce(F.max("version"), F.lit(0)) + 1)
    new = version.toDF("version").select(F.lit(branch).alias("branch"), F.col("version").cast("int"), F.lit(sha).alias("sha"), F.lit(at).cast("timestamp").alias("timestamp"), F.array().cast("array<string>").alias("files_viewed"), F.lit(0).cast("long").alias("notes_count"))
    return rounds.unionByName(new)


def _is_latest(rounds: DataFrame, branch: str) -> DataFrame:
    last = rounds.groupBy(F.col("branch").alias("b")).agg(F.max("version").alias("v"))
    return rounds.join(last, F.col("branch") == F.col("b"), "left").withColumn("is_last", (F.col("version") == F.col("v")) & (F.col("branch") == branch))


def mark_viewed(rounds: DataFrame, branch: str, paths: list[str]) -> DataFrame:
    """Adds paths to those viewed in the branch's last round."""
    added = F.array_union("files_viewed", F.array(*(F.lit(p) for p in paths)).cast("array<string>"))
    return _is_latest(rounds, branch).withColumn("files_viewed", F.when(F.col("is_last"), added).otherwise(F.col("files_viewed"))).select(*rounds.columns)


def close_session(rounds: DataFrame, branch: str, viewed: list[str], notes: int) -> DataFrame:
    """Writes what was viewed, by path, and the number of notes into the branch's last round."""
    paths = F.array(*(F.lit(p) for p in viewed)).cast("array<string>")
    out = _is_latest(rounds, branch).withColumn("files_viewed", F.when(F.col("is_last"), paths).otherwise(F.col("files_viewed")))
    return out.withColumn("notes_count", F.when(F.col("is_last"), F.lit(notes).cast("long")).otherwise(F.col("notes_count"))).select(*rounds.columns)


def viewed_files(files: DataFrame, rounds: DataFrame) -> DataFrame:
    """Files that were viewed in the last round of a branch."""
    seen = latest_round(rounds).select(F.explode("files_viewed").alias("path")).distinct()
    return files.join(seen, "path", "left_semi")


def progress(files: DataFrame, viewed: DataFrame) -> DataFrame:
    """Viewed and all files per change, and the share, at most 1."""
    seen = viewed.select("change_id", "path").distinct().withColumn("seen", F.lit(1))
    out = files.join(seen, ["change_id", "path"], "left").groupBy("change_id").agg(F.count("seen").alias("viewed"), F.count("*").alias("total"))
    return out.withColumn("share", F.least(F.lit(1.0), F.col("viewed") / F.col("total")))


def add_note(notes: DataFrame, branch: str, file: str, line: int | None, content: str, at: datetime) -> DataFrame:
    """Appends a note, whose id holds the time, the line and how many notes the branch had."""
    n = notes.filter(F.col("branch") == branch).agg(F.count("*").alias("n"))
    when, where = F.lit(at).cast("timestamp"), F.lit(line).cast("int")
    new = n.select(F.lit(branch).alias("branch"), note_id(when, where, F.col("n")).alias("id"), F.lit(file).alias("file"), where.alias("line"), F.lit(content).alias("content"), when.alias("created_at"))
    return notes.unionByName(new)


def delete_note(notes: DataFrame, id_: str) -> DataFrame:
    return notes.filter(F.col("id") != id_)


def notes_for(notes: DataFrame, file: str) -> DataFrame:
    return notes.filter(F.col("file") == file)


def note_lines(notes: DataFrame) -> DataFrame:
    """Lines of each file that have notes."""
    return notes.filter("line is not null").select("branch", "file", "line").distinct()
