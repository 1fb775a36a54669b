"""Streaming forms of operators that have a time: churn over a sliding month, states between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_churn(commits: DataFrame, days: int = 30, slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Commits and (about) authors per path in windows of days, for a stream of (path, author, ts); rows later than late
    are left out. Distinct counts have no exact streaming form, so authors are counted approximately."""
    windows = F.window("ts", f"{days} days", slide)
    return commits.withWatermark("ts", late).groupBy(windows.alias("w"), "path").agg(F.count("*").alias("commit_count"), F.approx_count_distinct("author").alias("author_count")).select(F.col("w.end").alias("as_of"), "path", "commit_count", "author_count")


def _states(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    for batch in batches:
        for r in batch.sort_values("version").itertuples(index=False):
            rows.append((key[0], key[1], r.version, "new" if last is None else "unchanged" if last == r.digest else "modified"))
            last = r.digest
    state.update((last,))
    yield pd.DataFrame(rows, columns=["change_id", "path", "version", "state"])


def round_states(digests: DataFrame) -> DataFrame:
    """For a stream of (change_id, path, version, digest): new, modified or unchanged against the file's last round."""
    return digests.groupBy("change_id", "path").applyInPandasWithState(_states, "change_id string, path string, version int, state string", "digest string", "append", GroupStateTimeout.NoTimeout)
