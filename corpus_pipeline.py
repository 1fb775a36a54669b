"""The corpus pipeline: toxicity, exact dedup, near-duplicate dedup, mixing and packing of documents.

Each stage works on all its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from deltaloom.llm.queries import tokenizer_path
from deltaloom.llm.support import stage, table


#: Rows that a stage drops and that are broadcast at most, when their number is known (some 50 bytes each); of more, texts are shuffled.
MAX_BROADCAST = 1_000_000


#: Rows that Spark hands to Python at once: five stages follow each other in the same executors, whose Python workers stay.
ARROW_ROWS = 400


def _small_batches(spark: SparkSession) -> None:
    """The pipeline is an application and so may set up its session; its operators do not."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _sized(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where it is small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. The models learn from labels outside the held-out fold. Null and
    empty texts are scored as texts without evidence; repeated rows are judged each, and alike."""
    _small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=tuple(docs.columns)).filter("predicted = 0")
    return scored.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of repeated rows of it one stays. Null text is empty."""
    told = exact_dedup.exact_dedup(docs).select("kept", F.col("doc_id").alias("told_id"), F.col("text_sha256").alias("told_digest"))
    told = stage(told.groupBy("told_id", "told_digest").agg(F.first("kept").alias("kept"), F.count("*").alias("rows")).filter("not kept or rows > 1"), "pipeline-told")
    digest = F.sha2(exact_dedup.ascii_fold(F.col("text")), 256)
    same = F.col("told_id").eqNullSafe(F.col("doc_id")) & (F.col("told_digest") == F.col("digest"))
    keyed = docs.withColumn("digest", digest)
    left = keyed.join(_sized(told), same, "left_anti").select(*docs.columns)
    repeated = told.filter("kept")
    if repeated.isEmpty():
        return left
    # Repeated rows of what is kept: one of each.
    return left.unionByName(keyed.join(_sized(repeated), same, "left_semi").dropDuplicates(["doc_id", "digest"]).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest doc_id. Rows without doc_id and rows
    without words stay."""
    _small_batches(spark)
    groups = ngram_join.ngram_join(docs)
    going = stage(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("going")).distinct(), "pipeline-going")
    return docs.join(_sized(going), F.col("doc_id") == F.col("going"), "left_anti").select(*docs.columns)


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes of all columns, nulls told apart from what hashes like them: 128 bits by which rows are found again."""
    parts = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(i), *parts) for i in range(2)]


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Rows that are equal in all columns are taken as
    often as they are drawn together; documents without words are not taken."""
    _small_batches(spark)
    keys = ["row_key0", "row_key1"]
    drawn = mixing.mix(docs, row_key=row_key(docs)).groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    drawn = stage(drawn.filter("_copies > 0").toDF("_key0", "_key1", "_copies", "_rows"), "pipeline-drawn")
    keyed = docs.withColumns({f"_key{i}": c for i, c in enumerate(row_key(docs))})
    taken = keyed.join(drawn.filter("_rows = 1"), ["_key0", "_key1"])
    repeated = drawn.filter("_rows > 1")
    if not repeated.isEmpty():
        taken = taken.unionByName(keyed.join(_sized(repeated), ["_key0", "_key1"]).dropDuplicates(["_key0", "_key1"]))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Null and empty texts are one token; repeated rows are
    packed each."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The models of toxicity, the cube method's draws and the tokens have no SQL; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written and read again as the next one's documents; an empty
    table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
