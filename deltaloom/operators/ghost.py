"""Findings that a diff does not show: broken imports, missing tests, files that many others depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, stem

#: What follows the stem in the name of a test file.
TEST_MARKS = (".test.", ".spec.", "_test.")
#: The texts of findings.
MESSAGES = {
    "BrokenImport": "Deleted file `%s` is still imported by `%s`",
    "MissingTest": "Changed source file `%s` has no corresponding test file",
    "HighImpact": "High-impact change: `%s` is imported by %d other files",
}
#: From more dependents than this on, a file has high impact.
HIGH_IMPACT = 5


def _finding(df: DataFrame, severity: str, category: str, count=None) -> DataFrame:
    n = F.lit(None).cast("long") if count is None else count
    shown = {"BrokenImport": ["path", "other"], "MissingTest": ["path"], "HighImpact": ["path", n]}[category]
    message = F.format_string(MESSAGES[category], *shown)
    return df.select("change_id", "path", F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col("other").alias("related_file"), n.alias("dependent_count"), message.alias("message"))


def broken_imports(files: DataFrame, graph: DataFrame) -> DataFrame:
    """An error for each edge that leads to a deleted file."""
    gone = files.filter(F.col("status") == "Deleted").select("change_id", F.col("path").alias("dst"))
    return _finding(graph.join(gone, ["change_id", "dst"]).select("change_id", F.col("dst").alias("path"), F.col("src").alias("other")), "Error", "BrokenImport")


def tested_stems(parsed: DataFrame) -> DataFrame:
    """(change_id, test, stem): every text that ends where a test mark begins in a file's name. A changed file has a
    test if its stem is one of them, so that the search for the stem in all names becomes an equi-join."""
    name = file_name(F.col("path"))
    at = F.transform(F.array(*(F.lit(m) for m in TEST_MARKS)), lambda m: F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i, F.length(m)) == m))
    starts = parsed.select("change_id", F.col("path").alias("test"), name.alias("name"), F.array_distinct(F.flatten(at)).alias("at")).select("change_id", "test", "name", F.explode("at").alias("end"))
    stems = F.transform(F.sequence(F.lit(1), F.col("end")), lambda i: F.substr("name", i, F.col("end") - i))
    return starts.select("change_id", "test", F.explode(stems).alias("stem")).distinct()


def missing_tests(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """A warning for each changed Source file (deleted ones included) without a test file of its name."""
    sources = files.filter(F.col("category") == "Source").withColumn("stem", stem(F.col("path")))
    tested = sources.join(tested_stems(parsed), ["change_id", "stem"]).filter(F.col("test") != F.col("path")).select("change_id", "path").distinct()
    return _finding(sources.join(tested, ["change_id", "path"], "left_anti").withColumn("other", F.lit(None).cast("string")), "Warning", "MissingTest")


def high_impact(files: DataFrame, graph: DataFrame, distinct_dependents: bool = False) -> DataFrame:
    """A note for each changed file with more than HIGH_IMPACT incoming edges (or importing files)."""
    counted = graph.groupBy("change_id", F.col("dst").alias("path")).agg((F.count_distinct("src") if distinct_dependents else F.count("*")).alias("n"))
    found = files.select("change_id", "path").join(counted.filter(F.col("n") > HIGH_IMPACT), ["change_id", "path"]).withColumn("other", F.lit(None).cast("string"))
    return _finding(found, "Info", "HighImpact", F.col("n"))


def ghost_findings(files: DataFrame, parsed: DataFrame, graph: DataFrame, distinct_dependents: bool = False) -> DataFrame:
    return broken_imports(files, graph).unionByName(missing_tests(files, parsed)).unionByName(high_impact(files, graph, distinct_dependents))


def finding_counts(findings: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("change_id").agg(of("Error").alias("errors"), of("Warning").alias("warnings"), of("Info").alias("infos"))
