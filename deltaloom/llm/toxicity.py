"""Toxicity by class-conditional Kneser-Ney models with shared backoff."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import lean, stage
from .textblocks import M1, M4, U, flat, mix, word_hashes, words

#: Of so many labelled rows at most, an even sample by hash, those of fold 3 calibrate. Counts are of all rows.
MAX_LABELLED = 30_000
#: Labels that are broadcast to the texts at most (some 40 bytes each); of more, the labels and texts are shuffled.
MAX_BROADCAST = 4_000_000
#: Expressions that are held and broadcast at once (some 16 bytes each); of more, texts are scored in several passes.
PART_EXPRESSIONS = 2_000_000
#: Absolute discount, and the log-likelihood ratio statistic from which classes have counts of their own for an
#: expression; others have the counts of both classes together, and back off alike.
DISCOUNT, EVIDENCE = 0.75, 10.0
#: Bytes of a word's stem, to which unknown words back off.
STEM = 6
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: The three orders of expressions.
STEMS, WORDS, PAIRS = 0, 1, 2

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BLANKED = np.where(_NOT_LETTER, 32, np.arange(256)).astype(np.uint8)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct pair of neighbouring words (runs of letters) in each text: the text, the word before (0 at the
    beginning of a text), the word and its stem, as hashes. What a text says over and over it says once."""
    b, offsets = flat(column)
    b = _BLANKED[b]
    starts, _, counts = words(b, offsets)
    one = word_hashes(b, starts)
    if not len(one):
        return np.empty(0, np.int64), *[one] * 3
    spans = np.diff(np.append(starts, len(b)))
    inside = np.arange(starts[0], len(b)) - np.repeat(starts, spans)
    b[starts[0] :][inside >= STEM] = 32
    stem = word_hashes(b, starts)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([np.zeros(1, np.uint64), one[:-1]])
    begin = np.cumsum(counts) - counts
    before[begin[counts > 0]] = U(0)
    pair = pair_keys(before, one)
    order = np.lexsort((pair, text)) if len(counts) > 1 else np.argsort(pair)
    k, t = pair[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    kept = order[new]
    return text[kept], before[kept], one[kept], stem[kept]


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * M1 + word * M4)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: (order, a, b, ordinary texts that have it, toxic ones), of pairs (word before, word), words (stem,
    word) and stems (0, stem)."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        text, before, word, stem = tokens(batch.column("text"))
        for order, a, b in ((STEMS, np.zeros_like(stem), stem), (WORDS, stem, word), (PAIRS, before, word)):
            if not len(b):
                continue
            key = pair_keys(a, b)
            by = np.lexsort((text, key))
            k, t = key[by], text[by]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
            by = by[new]  # one of each text and expression
            first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            n = np.diff(np.append(first, len(by)))
            ones = np.add.reduceat(toxic[text[by]].astype(np.int64), first)
            at = by[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), order, np.int8)), pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array((n - ones).astype(np.int64)), pa.array(ones)], ["kind", "a", "b", "n", "t"])


def kneser_ney(own: Column, total: Column, mass: Column, backoff: Column) -> Column:
    """Discounted share of the own count, plus the mass that discounting leaves times the backoff probability."""
    return F.greatest(own - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1.0)) + mass * backoff


def expressions(counted: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """(kind, key, value): what each stem, word and pair with class counts of its own adds to the log-likelihood
    ratio (toxic to ordinary) of a word beyond what it backs off to.

    Interpolated Kneser-Ney of three orders. A pair backs off to its word, a word to its share of its stem, a stem to
    its share of all stems; shares are by continuation counts of both classes: words by how many different words they
    follow, stems by how many words they begin. An expression whose counts do not tell the classes apart (evidence)
    has those of both together, so that only what it backs off to differs between the classes; a pair without evidence
    backs off wholly. counted: (kind, a, b, n, t) of _count, summed.
    """
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.sum("t").alias("t")).collect()}
    if len(sums) < 3 or not sums[WORDS]["n"] or not sums[WORDS]["t"]:
        return counted.select("kind", F.col("a").alias("key"), F.lit(0.0).alias("value")).limit(0)
    total = {k: (F.lit(float(r["n"])), F.lit(float(r["t"]))) for k, r in sums.items()}
    mass = {k: F.lit(DISCOUNT * r["types"] / (r["n"] + r["t"])) for k, r in sums.items()}
    share = F.lit(sums[WORDS]["t"] / (sums[WORDS]["n"] + sums[WORDS]["t"]))
    both = F.col("n") + F.col("t")

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    told = 2 * (part(F.col("t"), both * share) + part(F.col("n"), both * (1 - share)))
    kept = stage(counted.filter(told >= evidence), "toxicity-kept")
    stems, own, pairs = (kept.filter(F.col("kind") == k).select("a", "b", "n", "t") for k in (STEMS, WORDS, PAIRS))
    # Continuation counts of those that are kept, from all pairs and words.
    needed = own.select("b").unionByName(pairs.select("b")).distinct().withColumnRenamed("b", "needed")
    follows = counted.filter(F.col("kind") == PAIRS).join(needed, F.col("b") == F.col("needed")).groupBy(F.col("b").alias("w")).agg(F.count("*").alias("follows"))
    begins = counted.filter(F.col("kind") == WORDS).join(stems.select(F.col("b").alias("needed")), F.col("a") == F.col("needed")).groupBy(F.col("a").alias("s")).agg(F.count("*").alias("begins"))
    # Stems: what each class has more of it than both have.
    shared = F.col("begins") / F.lit(float(sums[WORDS]["types"]))
    pooled = kneser_ney(both, total[STEMS][0] + total[STEMS][1], mass[STEMS], shared)
    stems = stems.join(begins, F.col("b") == F.col("s")).select("s", *((kneser_ney(F.col(c), total[STEMS][i], mass[STEMS], shared) / pooled).alias(f"s{c}") for i, c in enumerate("nt")))
    stems = stage(stems, "toxicity-stems")
    stem_of = counted.filter(F.col("kind") == WORDS).join(needed, F.col("b") == F.col("needed")).select(F.col("b").alias("w_"), F.col("a").alias("stem"))
    words_ = follows.join(stem_of, F.col("w") == F.col("w_")).join(stems, F.col("stem") == F.col("s"), "left")
    words_ = words_.join(own.select(F.col("b").alias("o"), "n", "t"), F.col("w") == F.col("o"), "left")
    base = F.col("follows") / F.lit(float(sums[PAIRS]["types"]))
    backoff = {c: base * F.coalesce(F.col(f"s{c}"), F.lit(1.0)) for c in "nt"}
    words_ = words_.select("w", F.col("o").isNotNull().alias("own"), F.log(F.coalesce(F.col("st") / F.col("sn"), F.lit(1.0))).alias("stem_ratio"), *(F.when(F.col("o").isNull(), backoff[c]).otherwise(kneser_ney(F.col(c), total[WORDS][i], mass[WORDS], backoff[c])).alias(f"w{c}") for i, c in enumerate("nt")))
    words_ = stage(words_, "toxicity-words")
    contexts = counted.filter(F.col("kind") == PAIRS).join(pairs.select(F.col("a").alias("needed")).distinct(), F.col("a") == F.col("needed"))
    contexts = contexts.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("followers"), F.sum("n").alias("vn"), F.sum("t").alias("vt"))
    left = F.lit(DISCOUNT) * F.col("followers") / (F.col("vn") + F.col("vt"))
    pairs = pairs.join(contexts, F.col("a") == F.col("v")).join(words_, F.col("b") == F.col("w"))
    ratio = F.log(kneser_ney(F.col("t"), F.col("vt"), left, F.col("wt")) / kneser_ney(F.col("n"), F.col("vn"), left, F.col("wn")))
    out = stems.select(F.lit(STEMS).alias("kind"), F.col("s").alias("key"), F.log(F.col("st") / F.col("sn")).alias("value"))
    out = out.unionByName(words_.filter("own").select(F.lit(WORDS).alias("kind"), F.col("w").alias("key"), (F.log(F.col("wt") / F.col("wn")) - F.col("stem_ratio")).alias("value")))
    paired = pairs.select("a", "b", (ratio - F.log(F.col("wt") / F.col("wn"))).alias("value"))
    return out.unionByName(paired.mapInArrow(_pair_keys, "kind int, key long, value double"))


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab")
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), PAIRS, np.int32)), pa.array(pair_keys(a, b).view(np.int64)), batch.column("value")], ["kind", "key", "value"])


class Expressions:
    """Sorted keys and values of each order."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray):
        self.held = []
        for order in (STEMS, WORDS, PAIRS):
            k, v = key[kind == order].astype(np.int64).view(np.uint64), value[kind == order]
            by = np.argsort(k)
            self.held.append((k[by], v[by]))

    def sums(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: log-likelihood ratio of its distinct pairs, and how many it has."""
        text, before, word, stem = tokens(column)
        ratio = sum((_look_up(*held, keys) for held, keys in zip(self.held, (stem, word, pair_keys(before, word)), strict=True)), np.zeros(len(text)))
        return np.bincount(text, ratio, len(column)), np.bincount(text, minlength=len(column))


@dataclass
class Model:
    """The table of expressions(), in so many parts that each can be broadcast, and the weights of calibrated()."""

    table: DataFrame
    parts: int
    weights: np.ndarray

    def part(self, i: int) -> Expressions:
        rows = self.table.filter(F.pmod(F.xxhash64("key"), F.lit(self.parts)) == i).toPandas()
        return Expressions(rows["kind"].to_numpy(np.int64), rows["key"].to_numpy(np.int64), rows["value"].to_numpy(float))

    def summed(self, rows: DataFrame) -> DataFrame:
        """rows with ratio (log-likelihood ratio of the column _text) and pairs (how many distinct pairs it has)."""
        names = rows.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", ratio double, pairs long"
        for i in range(self.parts):
            held = rows.sparkSession.sparkContext.broadcast(self.part(i))
            more = i > 0

            def run(batches: Iterator[pa.RecordBatch], held=held, more=more) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ratio, pairs = held.value.sums(batch.column("_text"))
                    if more:
                        ratio = ratio + batch.column("ratio").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ratio, pa.float64()), pa.array(pairs.astype(np.int64))], [*names, "ratio", "pairs"])

            rows = rows.mapInArrow(lean(run), schema)
            if i + 1 < self.parts:  # else the executors would hold all parts at once
                rows = stage(rows, "toxicity-sums")
        return rows


def calibrated(ratio: Column, pairs: Column) -> list[Column]:
    """What the calibration weighs: a constant, the length-normalised difference of the log-likelihoods, the same in
    units of its standard error, and the logarithm of the length."""
    n = F.greatest(pairs, F.lit(1)).cast("double")
    return [F.lit(1.0), 20 * ratio / n, ratio / F.sqrt(n), F.log(n)]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Newton's method; a step is halved until the loss falls by it, as whole steps can go back and forth for ever
    where the classes are nearly apart."""
    held = ridge * (np.arange(x.shape[1]) > 0)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - z @ y + held @ w**2 / 2)

    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    now = loss(w)
    for _ in range(rounds):
        p = (1 + np.tanh(x @ w / 2)) / 2
        grad = x.T @ (p - y) + held * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(np.maximum(held, 1e-6))
        step = np.linalg.solve(hess, grad)
        if np.abs(step).max() < 1e-7:
            break
        part = 1.0
        while (then := loss(w - part * step)) > now - 1e-4 * part * (grad @ step) and part > 1e-12:
            part /= 2
        if then >= now:  # as low as rounding lets it
            break
        w, now = w - part * step, then
    return w


def fold(doc_id: str = "doc_id"):
    """crc32 of the decimal doc_id, modulo 4: 0 and 1 fit the models, 3 calibrates, 2 is held out. Null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mark: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fits the models on all labelled rows of folds 0 and 1 and calibrates them on fold 3, of which an even sample
    is taken when more than max_labelled rows outside fold 2 have labels.

    Without a row of either class the score is a constant: the share of toxic rows, 0 without labels. Repeated
    labels of a document count once, toxic if any is; null marks are no labels; of repeated documents each row counts.
    """
    marks = labels.filter(F.col(mark).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("mark_id")).agg(F.max(F.col(mark).cast("int")).alias("toxic"))
    marks = marks.withColumn("fold", fold("mark_id")).filter("fold <> 2")
    n = marks.count()
    shown = marks.filter("fold = 3")
    if n > max_labelled:  # an even sample by hash; 2 ** 20 steps
        shown = shown.filter(F.pmod(F.xxhash64("mark_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    learnt = marks.filter("fold < 2")
    rows = texts.filter(fold() < 2).join(F.broadcast(learnt) if n <= MAX_BROADCAST else learnt, F.col("doc_id") == F.col("mark_id"))
    counted = rows.select(F.col("_text").alias("text"), "toxic").mapInArrow(lean(_count), "kind byte, a long, b long, n long, t long")
    counted = stage(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "expressions")
    table = stage(expressions(counted), "toxicity-expressions")
    model = Model(table, max(1, math.ceil(table.count() / PART_EXPRESSIONS)), np.zeros(4))
    rows = texts.join(F.broadcast(shown), F.col("doc_id") == F.col("mark_id")).select("_text", "toxic")
    x = calibrated(F.col("ratio"), F.col("pairs"))
    shown = model.summed(rows).select("toxic", *(c.alias(f"x{i}") for i, c in enumerate(x))).toPandas()
    if shown["toxic"].nunique() == 2:
        model.weights = _logistic(shown[[f"x{i}" for i in range(len(x))]].to_numpy(float), shown["toxic"].to_numpy(float))
    else:
        rate = marks.agg(F.avg("toxic")).first()[0] or 0.0
        model.weights = np.array([np.log((rate + 1e-6) / (1 - rate + 1e-6)), 0, 0, 0])
    return model


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row, from its whole text; carry names
    columns of docs to keep beside them, as _c0, _c1 and so on.

    The score is the calibrated difference of the length-normalised log-likelihoods. Empty, null and wordless texts have
    the score of no evidence; texts of any length count whole; repeated rows are scored each; null doc_id is kept; an
    empty table gives an empty result; other columns are ignored. Up to PART_EXPRESSIONS expressions are broadcast at
    once; a model of more is applied part by part, with a table written between.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry) if c != text))
    z = sum((F.lit(float(w)) * c for w, c in zip(model.weights, calibrated(F.col("ratio"), F.col("pairs")), strict=True)), F.lit(0.0))
    kept = [F.col("_text" if c == text else f"_c{i}").cast(docs.schema[c].dataType).alias(f"_c{i}") for i, c in enumerate(carry)]  # the text came once
    scored = model.summed(rows).select(F.col("_id").alias("doc_id"), (fold("_id") == 2).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"), *kept)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(f"_c{i}" for i in range(len(carry))))
