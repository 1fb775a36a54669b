"""python -m deltaloom: review, split, ghost, impact and inbox of a repository, as text or JSON."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import inbox as inbox_ops
from .operators import split as split_ops
from .plans import pipeline
from .sources import git, reports
from .sources import state as saved

STATE = ".deltaloom"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--json", action="store_true", default=argparse.SUPPRESS, help="print JSON instead of text")
    shared.add_argument("--base", default=argparse.SUPPRESS, help="base to compare with, by default the first usual branch")
    shared.add_argument("--repo", default=argparse.SUPPRESS, help="a folder of the repository")
    shared.add_argument("--verbose", "-v", action="store_true", default=argparse.SUPPRESS)
    parser = argparse.ArgumentParser(prog="deltaloom", parents=[shared])
    commands = parser.add_subparsers(dest="command")
    for name in ("review", "ghost", "stats", "notes"):
        commands.add_parser(name, parents=[shared])
    split = commands.add_parser("split", parents=[shared])
    split.add_argument("--dry-run", action="store_true", help="show the branches that the split stands for")
    split.add_argument("--prefix", default="split")
    commands.add_parser("impact", parents=[shared]).add_argument("file")
    box = commands.add_parser("inbox", parents=[shared])
    box.add_argument("--pulls", required=True, help="JSON file of open pull requests, as the hosting service lists them")
    box.add_argument("--user", required=True)
    args = parser.parse_args(argv)
    for name, value in (("json", False), ("base", None), ("repo", "."), ("verbose", False)):
        if not hasattr(args, name):
            setattr(args, name, value)
    args.command = args.command or "review"
    return args


def _sides(spark: SparkSession, repo: str, base: str):
    # read once: each use of a snapshot would ask git again
    return (git.snapshot(spark, repo, ref).withColumn("change_id", F.lit("change")).persist() for ref in (base, "HEAD"))


def _only(df) -> str | None:
    row = df.first()
    return row["document"] if row else None


def _pretty(document: str | None) -> str:
    return json.dumps(json.loads(document or "{}"), indent=2, ensure_ascii=False)


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    """What a command prints, and its exit code."""
    if args.command in ("stats", "notes"):
        return f"{args.command}: not implemented", 0
    now = datetime.now(UTC).replace(tzinfo=None)
    if args.command == "inbox":
        prs = inbox_ops.inbox(inbox_ops.list_pull_requests(inbox_ops.pull_requests(spark.read.option("multiLine", True).json(args.pulls), F.lit(now))), args.user)
        if args.json:
            return _pretty(_only(reports.inbox_document(prs, args.user))), 0
        rows = prs.select("box", "number", inbox_ops.line(F.lit(now)).alias("line")).orderBy(F.desc("number")).collect()
        parts = [[f"{title} ({len(own)}):", *own, ""] for title, box in (("Your PRs", "mine"), ("Review Requested", "review")) if (own := [r.line for r in rows if r.box == box])]
        return "\n".join(["PR Inbox\n", *(x for p in parts for x in p)] if parts else ["PR Inbox\n", "No open pull requests found."]), 0
    repo = git.discover(args.repo)
    config = saved.load_config(os.path.join(repo, STATE, "config.yaml"))
    base = args.base or (None if args.command == "impact" else git.detect_base(repo))
    graph = None
    if args.command != "review":
        graph = pipeline.dependency_graph(git.worktree(spark, repo).withColumn("change_id", F.lit("change")).persist())
        graph = {name: df.persist() for name, df in graph.items()}
    if args.command == "impact":
        found = pipeline.impacts(spark.createDataFrame([("change", args.file)], "change_id string, path string"), graph)
        document = _only(reports.impact_documents(found, args.file))
        empty = json.dumps({"file": args.file, "direct_count": 0, "transitive_count": 0, "total": 0, "impacted": []})
        return (_pretty(document or empty) if args.json else reports.impact_text(document, args.file)), 0
    out = pipeline.review(*_sides(spark, repo, base), git.commits(spark, repo, since=now.timestamp() - 30 * 86400).persist(), F.lit(now), config)
    out["files"] = out["files"].persist()
    if args.command == "ghost":
        document = _only(reports.ghost_documents(pipeline.ghosts(out["files"], graph), out["files"]))
        if args.json:
            return _pretty(document or json.dumps({"findings": [], "error_count": 0, "warning_count": 0, "info_count": 0})), 0
        return reports.ghost_text(document, git.current_branch(repo), base), int(bool(document) and json.loads(document)["error_count"] > 0)
    if args.command == "split":
        plan = pipeline.split_change(out["files"], graph, config)
        document = _only(reports.split_documents(plan))
        if args.json:
            return _pretty(document), 0
        text = reports.split_text(document)
        if args.dry_run:
            rows = split_ops.branch_plan(plan["groups"], plan["depends"], base, args.prefix).orderBy("group_index").collect()
            text += "\n\nDry run — branches that would be created:\n" + "\n".join(f"  {r.branch_name} ({r.file_count} files)" for r in rows)
        return text, 0
    if args.json:
        hunks = out["hunks"].join(out["spans"], ["change_id", "file_idx", "hunk_idx"])
        nested = saved.nested_diff(out["files"], hunks, out["lines"], out["summary"], base, "HEAD")
        return _pretty(_only(nested.select(F.to_json(F.struct("base_ref", "head_ref", "files", "summary")).alias("document")))), 0
    rows = out["files"].orderBy("position").collect()
    return "\n".join(f"{r.priority:<7} {r.priority_score:8.1f}  {r.status[0]} {r.path} (+{r.additions}/-{r.deletions})" for r in rows) or "No changes.", 0


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("deltaloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    text, code = run(spark, args)
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
