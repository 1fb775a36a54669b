"""Mixing sources to target weights by the cube method."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import stage

#: Nearer to 0 or 1 than this, a probability counts as decided.
TINY = 1e-9
#: Rows of a block in which one task walks; what is left of each block meets again in the next level.
BLOCK_ROWS = 2000


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, limit: float) -> dict[str | None, float]:
    """Each source's target: share of all sizes by weight, at most limit times its own size; what exceeds that
    goes to the others by weight until no target is above. Sources count by code point, null last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        left, total = goal - sum(full.values()), sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if given[s] > limit * sizes[s]]
        if not above:
            return {s: full.get(s, given.get(s, 0.0)) for s in order}
        full |= {s: float(limit * sizes[s]) for s in above}


def _walk(p: list[float], at: list[int], x: list[int], rng, constraints: int) -> list[int]:
    """Flight phase on the units at: moves groups of constraints + 1 probabilities through the null space of
    their constraints (number of units and their sizes) until one is 0 or 1; returns the undecided units."""
    held: list[int] = []
    draws, k = rng.random(len(at) + 8), 0
    for i in at:
        held.append(i)
        if len(held) <= constraints:
            continue
        if constraints == 2:
            a, b, c = held
            u = (float(x[c] - x[b]), float(x[a] - x[c]), float(x[b] - x[a]))
            if u[0] == u[1] == u[2] == 0:
                u = (1.0, -1.0, 0.0)
        elif constraints == 1:
            a, b = held
            u = (float(x[b]), -float(x[a])) if x[a] or x[b] else (1.0, -1.0)
        else:
            u = (1.0,)
        up = down = math.inf
        for j, v in zip(held, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[j]) / v), min(down, p[j] / v)
            elif v < 0:
                up, down = min(up, -p[j] / v), min(down, -(1 - p[j]) / v)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for j, v in zip(held, u, strict=True):
            q = p[j] + step * v
            p[j] = 0.0 if q < TINY else 1.0 if q > 1 - TINY else q
        held = [j for j in held if 0 < p[j] < 1]
    return held


def _flight(seed: int, last: bool):
    """A function over one block's table that decides as many of its units as the constraints let it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # Large documents walk first, so that the units left over are small ones.
        keys = [c for c in rows.column_names if c.startswith("row_key")]
        rows = rows.sort_by([("size", "descending"), *((c, "ascending") for c in ("turn", "doc_id", *keys))])
        p, x = rows["p"].to_pylist(), rows["size"].to_pylist()
        rng = np.random.default_rng([seed, len(p), *(abs(int(v.as_py() or 0)) & 0xFFFFFFFF for v in key[1:]), int(sum(x)) & 0xFFFFFFFF])
        left = _walk(p, [i for i, v in enumerate(p) if 0 < v < 1], x, rng, 2)
        if last:  # landing: give up the number of units, then the sizes
            for constraints in (1, 0):
                left = _walk(p, left, x, rng, constraints)
        return rows.set_column(rows.column_names.index("p"), "p", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 7, block_rows: int = BLOCK_ROWS, row_key: Sequence[Column] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target, copies, taken, and row_key0, row_key1, ...
    with row_key, simple columns over docs by which a caller finds the very rows again where doc_id is repeated.

    A source's ratio is target / source_size; each of its documents is taken floor(ratio) times, and once more
    with probability the rest, drawn by the cube method so that the extra documents and their words come near
    their expectation. Block by block (source, hash of doc_id) a flight phase leaves two undecided units at
    most; these meet in blocks of the next level, and the last one per source lands. Draws depend on seed and
    the rows only, so reruns agree.

    Defined results: null text has size 0; null source is a source of its own, last in order; sources without
    words have target 0 and copies 0; repeated rows are units of their own; an empty table
    gives an empty result; other columns are ignored. Per-source totals, one row per
    source, come to the driver; their plan is joined, and broadcast only where Spark finds it small.
    """
    spark = docs.sparkSession
    sized = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), *(c.alias(f"row_key{i}") for i, c in enumerate(row_key))), "mix-sizes")
    totals = {r["source"]: (r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    targets = source_targets({s: v for s, (v, _) in totals.items()}, weights, share, limit) if totals else {}
    plan = [(s, int(v), float(targets[s]), math.floor(r := targets[s] / v if v else 0.0), r - math.floor(r), max(1, math.ceil(n / block_rows))) for s, (v, n) in totals.items()]
    plan = spark.createDataFrame(plan, "plan_source string, source_size long, target double, whole int, p double, blocks int")
    units = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    units = units.withColumn("p", F.when((F.col("p") < TINY) | (F.col("size") == 0), 0.0).when(F.col("p") > 1 - TINY, 1.0).otherwise(F.col("p")))
    units = units.withColumn("turn", F.xxhash64("doc_id", F.lit(seed))).withColumn("block", F.pmod(F.xxhash64("turn", "size"), F.col("blocks")).cast("int"))
    open_ = units.filter("p > 0 and p < 1")
    done = [units.filter("p = 0 or p = 1")]
    most, level = max((math.ceil(n / block_rows) for _, n in totals.values()), default=1), 0
    while True:
        last = most == 1
        out = stage(open_.groupBy("source", "block").applyInArrow(_flight(seed + level, last), open_.schema), f"mix-level{level}")
        done.append(out.filter("p = 0 or p = 1"))
        if last:
            break
        most, level = math.ceil(2 * most / block_rows), level + 1
        open_ = out.filter("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("turn", F.lit(level)), F.lit(most)).cast("int"))
    every = done[0]
    for df in done[1:]:
        every = every.unionByName(df)
    copies = (F.col("whole") + F.col("p").cast("int")).alias("copies")
    keys = [f"row_key{i}" for i in range(len(row_key))]
    return every.select("doc_id", "source", "size", "source_size", "target", copies, *keys).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
