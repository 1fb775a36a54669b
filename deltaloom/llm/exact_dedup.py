"""Exact dedup by a log-structured merge index, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import stage

#: The letters that are folded before texts are compared.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that memtables are flushed to, besides that of an earlier index.
RUNS = 4
#: Bits of a filter for each entry of a run, and bits of one row of a filter (fixed by Spark's bitmap functions).
FILTER_BITS, ROW_BITS = 16, 1 << 15
#: Groups of copies that are broadcast at most, when their number is known; of more, rows are shuffled by digest.
MAX_BROADCAST = 1_000_000


def ascii_fold(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Pure ASCII takes the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest_of(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _pick(smallest: bool, column: str) -> Column:
    return (F.min if smallest else F.max)(column)


def flush(entries: DataFrame, smallest: bool) -> DataFrame:
    """Runs (run, digest, keep_id, group_size) of entries with the same columns: each task folds its share in a memtable
    (Spark's partial aggregation), and what is merged is written sorted by digest."""
    runs = entries.groupBy("run", "digest").agg(_pick(smallest, "keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return stage(runs.sortWithinPartitions("run", "digest"), "dedup-runs")


def filter_rows(runs: int) -> int:
    """Rows of the filter of each run, for so many entries in all."""
    return max(1, math.ceil(FILTER_BITS * runs / RUNS / ROW_BITS))


def _bit(rows: int) -> tuple[Column, Column]:
    """Row and position in the filter of a digest."""
    bit = F.pmod(F.xxhash64("digest"), F.lit(rows * ROW_BITS))
    return F.floor(bit / ROW_BITS).cast("int"), (bit % ROW_BITS)


def filters(runs: DataFrame, rows: int) -> DataFrame:
    """The filter of each run, as bitmaps: (filter_run, row, bits)."""
    row, position = _bit(rows)
    return runs.select(F.col("run").alias("filter_run"), row.alias("row"), position.alias("position")).groupBy("filter_run", "row").agg(F.bitmap_construct_agg("position").alias("bits"))


def probe(runs: DataFrame, held: DataFrame, rows: int) -> DataFrame:
    """The entries of runs, with maybe: whether the filter of some other run holds the digest."""
    every = F.explode(F.array(*(F.lit(i) for i in range(-1, RUNS)))).alias("probing")
    others = held.select("filter_run", F.col("row").alias("probed"), "bits", every).filter("probing <> filter_run").groupBy("probing", "probed").agg(F.bitmap_or_agg("bits").alias("bits"))
    row, position = _bit(rows)
    at = runs.withColumn("row", row).withColumn("position", position)
    found = at.join(others, (F.col("run") == F.col("probing")) & (F.col("row") == F.col("probed")), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("position") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("position") % 8).cast("int")).bitwiseAND(1) == 1
    return found.select(*runs.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def compact(probed: DataFrame, smallest: bool) -> DataFrame:
    """Merges runs to groups (digest, keep_id, group_size) of two rows or more: one identifier of each digest survives,
    sizes add up. Entries that no other run can hold are merged already."""
    settled = probed.filter("not maybe").select("digest", "keep_id", "group_size")
    merged = probed.filter("maybe").groupBy("digest").agg(_pick(smallest, "keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return settled.unionByName(merged).filter("group_size > 1")


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", smallest: bool = False, normalise: Callable[[Column], Column] = ascii_fold) -> DataFrame:
    """An index for later calls: (digest, keep_id, group_size, body), one row per different normalised text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("keep_id"), normalise(F.col(text)).alias("body"), F.lit(1).cast("long").alias("group_size"))
    return rows.withColumn("digest", digest_of(F.col("body"))).groupBy("digest", "body").agg(_pick(smallest, "keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).select("digest", "keep_id", "group_size", "body")


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", smallest: bool = False, normalise: Callable[[Column], Column] = ascii_fold, index: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Of equal texts the row with the largest doc_id stays
    (the smallest with smallest=True). Memtables are flushed to RUNS sorted runs, dealt by doc_id; each entry
    probes the filters of the other runs, those that may be there are compacted, and all rows of a group are verified byte
    by byte. index: what build_index() gave for earlier documents, which is one more run and is verified likewise.

    Defined results: null text is empty text; all empty texts are one group; of repeated rows with the same doc_id all
    carry that keep_id and kept is true for each, as they cannot be told apart; null doc_id never wins over
    another id; equal digests of different texts are told apart by their bytes; an empty table gives an empty result;
    other columns, whatever their names, are ignored.

    Groups of any size: memtables fold by digest (and by bytes, when verified) before anything is shuffled, so each task
    sends one entry of a group at most. The last join has only the groups of copies on its other side, which are
    broadcast up to MAX_BROADCAST; beyond that it is plain with nothing above it, so that Spark can split a hot digest.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalise(F.col(text)).alias("body")).withColumn("digest", digest_of(F.col("body")))
    told = stage(rows.select("doc_id", "digest"), "dedup-digests")
    run = F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).cast("int")
    entries = told.select(run.alias("run"), "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if index is not None:
        entries = entries.unionByName(index.select(F.lit(-1).alias("run"), "digest", "keep_id", "group_size"))
    runs = flush(entries, smallest)
    size = filter_rows(runs.count())
    groups = stage(compact(probe(runs, stage(filters(runs, size), "dedup-filters"), size), smallest), "dedup-groups")
    few = groups.count() <= MAX_BROADCAST
    hits = groups.select(F.xxhash64("digest").alias("hit")).distinct()
    verified = rows.join(F.broadcast(hits), F.xxhash64("digest") == F.col("hit"), "left_semi") if few else rows
    bodies = verified.select("digest", "body")
    if index is not None:
        bodies = bodies.unionByName(index.select("digest", "body"))
    clashes = stage(bodies.distinct().groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("clash")), "dedup-clashes")
    found = groups.select(F.col("digest").alias("group"), "keep_id", F.col("group_size").alias("n"))
    whole = told.join(F.broadcast(found) if few else found, F.col("digest") == F.col("group"), "left")
    whole = whole.select("doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    out = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    if clashes.isEmpty():
        return whole.select(*out)
    # Different texts under one digest: those few rows are told apart by their bytes.
    plain = whole.join(clashes, F.col("digest") == F.col("clash"), "left_anti").select(*out)
    clashing = rows.join(clashes, F.col("digest") == F.col("clash"), "left_semi")
    sized = clashing.select(F.col("doc_id").alias("keep_id"), "body", F.lit(1).cast("long").alias("group_size"))
    if index is not None:
        sized = sized.unionByName(index.join(clashes, F.col("digest") == F.col("clash"), "left_semi").select("keep_id", "body", "group_size"))
    by_body = sized.groupBy(F.col("body").alias("b")).agg(_pick(smallest, "keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return plain.unionByName(clashing.join(by_body, F.col("body") == F.col("b")).select(*out))
