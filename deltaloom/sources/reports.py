"""Reports of the commands: a document per change as JSON, and the same as lines of text."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags of findings in texts.
TAGS = {"BrokenImport": "BROKEN_IMPORT", "MissingTest": "MISSING_TEST", "HighImpact": "HIGH_IMPACT"}


def _sorted(order: list[str], fields: list):
    """All rows of a group as an array in order, each with fields only."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("r"))))
    return F.transform(rows, lambda x: x["r"])


def ghost_documents(findings: DataFrame, files: DataFrame) -> DataFrame:
    """change_id and document: findings in the order of files (change_id, path, position), then the counts."""
    rank = F.coalesce(*(F.when(F.col("category") == c, i) for i, c in enumerate(TAGS)))
    rows = findings.join(files.select("change_id", "path", "position"), ["change_id", "path"]).withColumn("rank", rank)
    fields = [F.col("path").alias("file"), "severity", "category", "dependent_count", "message", "related_file"]
    of = lambda s: F.count_if(F.col("severity") == s)
    per = rows.groupBy("change_id").agg(_sorted(["position", "rank", "related_file"], fields).alias("findings"), of("Error").alias("error_count"), of("Warning").alias("warning_count"), of("Info").alias("info_count"))
    return per.select("change_id", F.to_json(F.struct("findings", "error_count", "warning_count", "info_count")).alias("document"))


def impact_documents(found: DataFrame, file: str) -> DataFrame:
    """found: change_id, path, depth, severity."""
    per = found.groupBy("change_id").agg(F.count_if(F.col("depth") == 1).alias("direct_count"), F.count_if(F.col("depth") > 1).alias("transitive_count"), F.count("*").alias("total"), _sorted(["depth", "path"], [F.col("path").alias("file"), "severity"]).alias("impacted"))
    return per.select("change_id", F.to_json(F.struct(F.lit(file).alias("file"), "direct_count", "transitive_count", "total", "impacted")).alias("document"))


def split_documents(plan: dict[str, DataFrame]) -> DataFrame:
    """plan: what split_plan() gives."""
    members = plan["members"].groupBy("change_id", "group_index").agg(_sorted(["position"], ["path"]).alias("m"))
    depends = plan["depends"].groupBy("change_id", "group_index").agg(F.array_sort(F.collect_set("depends_on")).alias("depends_on"))
    stats = F.struct("total_files", "total_additions", "total_deletions", "logic_lines").alias("stats")
    rows = plan["groups"].join(members, ["change_id", "group_index"]).join(depends, ["change_id", "group_index"], "left")
    fields = [F.col("group_index").alias("index"), "name", F.transform("m", lambda x: x["path"]).alias("files"), F.coalesce("depends_on", F.array().cast("array<int>")).alias("depends_on"), stats]
    groups = rows.groupBy("change_id").agg(_sorted(["group_index"], fields).alias("groups"))
    skipped = plan["skipped"].groupBy("change_id").agg(F.array_sort(F.collect_list("path")).alias("skipped_files"))
    issues = plan["issues"].groupBy("change_id").agg(_sorted(["group_index", "file", "missing_dep"], ["group_index", "file", "missing_dep", "message"]).alias("validation_issues"))
    every = groups.join(skipped, "change_id", "full_outer").join(issues, "change_id", "left")
    none = F.array().cast("array<string>")
    inner = F.struct(F.coalesce("groups", F.array()).alias("groups"), F.coalesce("skipped_files", none).alias("skipped_files"), none.alias("warnings")).alias("plan")
    return every.select("change_id", F.to_json(F.struct(inner, F.coalesce("validation_issues", F.array()).alias("validation_issues"))).alias("document"))


def inbox_document(prs: DataFrame, user: str) -> DataFrame:
    """One document of prs with box, newest numbers first."""
    fields = [c for c in prs.columns if c != "box"]
    box = lambda name: F.transform(F.filter("rows", lambda x: x["box"] == name), lambda x: x["r"])
    rows = prs.agg(F.array_sort(F.collect_list(F.struct((-F.col("number")).alias("o"), "box", F.struct(*fields).alias("r")))).alias("rows"))
    return rows.select(F.to_json(F.struct(F.lit(user).alias("user"), box("mine").alias("my_prs"), box("review").alias("review_prs"))).alias("document"))


def _parts(title: str, rows: list[str]) -> list[str]:
    return [f"{title} ({len(rows)}):", *rows, ""] if rows else []


def ghost_text(document: str | None, branch: str, base: str) -> str:
    d: dict[str, Any] = json.loads(document) if document else {"findings": []}
    head = f"Ghost analysis: {branch} vs {base}\n"
    if not d["findings"]:
        return f"{head}\nNo issues found. You're good to push!"

    def tag(f: dict) -> str:
        return f"{TAGS[f['category']]}({f['dependent_count']})" if f["category"] == "HighImpact" else TAGS[f["category"]]

    of = lambda s: [f for f in d["findings"] if f["severity"] == s]
    errors = [f"  [{tag(f)}] {f['file']}\n    {f['message']}" for f in of("Error")]
    others = {s: [f"  [{tag(f)}] {f['file']} — {f['message']}" for f in of(s)] for s in ("Warning", "Info")}
    rows = [*_parts("ERRORS", errors), *_parts("WARNINGS", others["Warning"]), *_parts("INFO", others["Info"])]
    return "\n".join([head, *rows, f"Summary: {d['error_count']} errors, {d['warning_count']} warnings, {d['info_count']} info"])


def impact_text(document: str | None, file: str) -> str:
    d = json.loads(document) if document else {"impacted": []}
    head = f"Impact analysis for: {file}\n"
    if not d["impacted"]:
        return f"{head}\nNo files depend on this file."
    direct = [f"  {x['file']}" for x in d["impacted"] if x["severity"] == "direct"]
    rest = [f"  {x['file']} ({x['severity'].removeprefix('transitive (').removesuffix(')').replace('depth ', 'depth: ')})" for x in d["impacted"] if x["severity"] != "direct"]
    return "\n".join([head, *_parts("Direct dependents", direct), *_parts("Transitive dependents", rest), f"Total: {len(d['impacted'])} files affected"])


def split_text(document: str | None) -> str:
    d = json.loads(document) if document else {"plan": {"groups": [], "skipped_files": []}, "validation_issues": []}
    plan = d["plan"]
    rows = [f"Split plan: {len(plan['groups'])} groups, {len(plan['skipped_files'])} skipped files\n"]
    for g in plan["groups"]:
        needs = f" [depends on: {', '.join(str(i + 1) for i in g['depends_on'])}]" if g["depends_on"] else ""
        rows += [f"  Group {g['index'] + 1}: {g['name']} ({g['stats']['total_files']} files, {g['stats']['logic_lines']} lines){needs}", *(f"    {f}" for f in g["files"]), ""]
    rows += [f"Skipped: {', '.join(plan['skipped_files'])}\n"] if plan["skipped_files"] else []
    issues = [f"  Group {i['group_index'] + 1}: {i['file']} depends on {i['missing_dep']} — {i['message']}" for i in d["validation_issues"]]
    return "\n".join([*rows, *(_parts("Validation issues", issues) or ["Validation: OK"])])
