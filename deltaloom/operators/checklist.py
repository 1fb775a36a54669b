"""Checklists: rules by path, merged with what was checked before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex


def rule_rows(spark: SparkSession, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Rules (glob, checks) with their regular expressions; invalid globs are left out."""
    rows = [(i, when, pattern, checks) for i, (when, checks) in enumerate(rules) if (pattern := glob_to_regex(when)) is not None]
    return spark.createDataFrame(rows, "rule_idx int, source_pattern string, pattern string, checks array<string>")


def resolve_checklist(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(change_id, path, item_idx, text, checked, source_pattern): the checks of all rules that match a file; of equal
    texts the first rule's stays. Rules are few by nature (a config file) and are broadcast by Spark when they are."""
    matched = files.select("change_id", "path").distinct().join(rules, F.expr("path rlike pattern"))
    items = matched.select("change_id", "path", "rule_idx", "source_pattern", F.posexplode("checks").alias("check_idx", "text"))
    first = items.groupBy("change_id", "path", "text").agg(F.min(F.struct("rule_idx", "check_idx", "source_pattern")).alias("f"))
    order = F.row_number().over(Window.partitionBy("change_id", "path").orderBy("f.rule_idx", "f.check_idx")) - 1
    return first.select("change_id", "path", order.cast("int").alias("item_idx"), "text", F.lit(False).alias("checked"), F.col("f.source_pattern").alias("source_pattern"))


def merge_checklist(items: DataFrame, saved: DataFrame) -> DataFrame:
    """Takes over checked from saved items (saved_idx, path, text, checked), the first of equal ones; saved items that are
    no longer asked for drop out."""
    was = saved.groupBy("path", "text").agg(F.min_by("checked", "saved_idx").alias("was"))
    return items.join(was, ["path", "text"], "left").withColumn("checked", F.coalesce("was", "checked")).select(*items.columns)


def toggle_item(items: DataFrame, path: str, text: str) -> DataFrame:
    hit = (F.col("path") == path) & (F.col("text") == text)
    return items.withColumn("checked", F.when(hit, ~F.col("checked")).otherwise(F.col("checked")))
