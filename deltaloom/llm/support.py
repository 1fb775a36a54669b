"""What several operators of this package share: tables, scratch space and block keys."""

from __future__ import annotations

import ctypes
import inspect
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that functions over batches get at once; long texts make larger batches costly in memory.
ARROW_ROWS = 400


def _return_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, whatever the session's setting is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(f: Callable, rows: int = ARROW_ROWS) -> Callable:
    """A function over batches (which get so many rows at most) or groups whose Python worker gives freed memory back when
    it is done; else the next tasks of the executor find less than there is, as workers stay."""

    def batches(found):
        try:
            yield from f(sliced(found, rows))
        finally:
            _return_memory()

    def group(*args):
        try:
            return f(*args)
        finally:
            _return_memory()

    if inspect.isgeneratorfunction(f):
        return lambda found: batches(found)
    # Spark counts the parameters to tell whether the key is wanted.
    return {1: lambda a: group(a), 2: lambda a, b: group(a, b), 3: lambda a, b, c: group(a, b, c)}[len(inspect.signature(f).parameters)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is set and Spark runs in this
    process alone (tests), as other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="deltaloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_WRITTEN: list[str] = []


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/deltaloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Removes the tables that stage() wrote in this process, once no result that reads them is wanted any more."""
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def text_bytes(text: str = "text") -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit("")))


def block_count(df: DataFrame, block_bytes: int, text: str = "text") -> int:
    """How many blocks of about block_bytes the texts fill; one at least."""
    total = df.agg(F.sum(text_bytes(text)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / block_bytes))


def block_of(doc_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(blocks)).cast("int")
