import subprocess
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltaloom import schemas
from deltaloom.operators import checklist, churn, diff, inbox, interdiff, queue, semantic, state
from deltaloom.plans import pipeline
from deltaloom.sources import git, state as saved
from deltaloom.streaming import churn as streams

NOW = datetime(2024, 3, 1)


def snap(spark, files):
    return spark.createDataFrame([("c", p, t) for p, t in files.items()], "change_id string, path string, content string")


def test_changed_files(spark):
    got = diff.changed_files(snap(spark, {"a": "1", "b": "1", "c": ""}), snap(spark, {"a": "2", "c": "", "d": None}))
    assert {r.path: r.status for r in got.collect()} == {"a": "Modified", "b": "Deleted"}
    got = diff.changed_files(snap(spark, {"a": "1"}), snap(spark, {"a": "1", "d": "x"}))
    assert {r.path: r.status for r in got.collect()} == {"d": "Added"}


def test_churn(spark):
    commits = spark.createDataFrame([("a", "x", NOW - timedelta(days=1)), ("a", "y", NOW - timedelta(days=2)), ("a", "x", NOW - timedelta(days=3)), ("b", "x", NOW - timedelta(days=4)), ("b", "x", NOW - timedelta(days=40)), ("z", "x", NOW)], "path string, author string, ts timestamp")
    files = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "n")], "change_id string, path string")
    got = churn.file_churn(commits, files, F.lit(NOW))
    assert {r.path: (r.commit_count, r.author_count, r.risk_multiplier) for r in got.collect()} == {"a": (3, 2, 1.5), "b": (1, 1, 0.5)}
    assert {r.path: r.risk for r in churn.with_risk(files, got).collect()} == {"a": 1.5, "b": 0.5, "n": 1.0}
    assert {r.risk for r in churn.with_risk(files, None).collect()} == {1.0}


def functions(spark, *rows):
    return spark.createDataFrame([("c", "f", i, n, p, r, i) for i, (n, p, r) in enumerate(rows)], "change_id string, path string, function_idx int, name string, params array<string>, return_type string, line int")


def test_function_changes(spark):
    old = functions(spark, ("a", [], None), ("b", ["x"], None), ("c", [], "int"), ("gone", [], None), ("twice", ["1"], None), ("twice", ["2"], None))
    new = functions(spark, ("a", [], None), ("b", ["y"], None), ("c", [], "str"), ("came", [], None), ("twice", ["2"], None))
    got = [(r.name, r.change) for r in semantic.function_changes(old, new).orderBy("change_idx").collect()]
    assert got == [("a", "BodyChanged"), ("b", "SignatureChanged"), ("c", "SignatureChanged"), ("came", "Added"), ("twice", "BodyChanged"), ("gone", "Deleted")]
    assert semantic.summaries(semantic.function_changes(old, new)).first().summary == "+1fn ~2sig -1fn"


def test_interdiff(spark):
    def round_(rows):
        files = spark.createDataFrame([("c", i, p) for i, (p, _) in enumerate(rows)], "change_id string, file_idx int, path string")
        lines = spark.createDataFrame([("c", i, 0, j, "Added", t) for i, (_, ls) in enumerate(rows) for j, t in enumerate(ls)], "change_id string, file_idx int, hunk_idx int, line_idx int, kind string, content string")
        return interdiff.content_digests(lines, files), files

    (before, _), (after, files) = round_([("a", ["x"]), ("b", ["1", "2"]), ("gone", ["z"]), ("empty", [])]), round_([("b", ["1", "3"]), ("a", ["x"]), ("new", ["n"]), ("empty", [])])
    states = interdiff.interdiff(before, after)
    assert {r.path: r.state for r in states.collect()} == {"a": "unchanged", "b": "modified", "gone": "removed", "new": "new", "empty": "unchanged"}
    assert sorted(r.path for r in interdiff.only_changed(files, states).collect()) == ["b", "new"]


def test_checklist(spark):
    rules = checklist.rule_rows(spark, [("*.ts", ["tests", "types"]), ("src/**", ["tests", "docs"]), ("[bad", ["x"])])
    files = spark.createDataFrame([("c", "src/a.ts"), ("c", "b.py")], "change_id string, path string")
    items = checklist.resolve_checklist(files, rules)
    assert [(r.path, r.text, r.source_pattern) for r in items.orderBy("item_idx").collect()] == [("src/a.ts", "tests", "*.ts"), ("src/a.ts", "types", "*.ts"), ("src/a.ts", "docs", "src/**")]
    was = spark.createDataFrame([(0, "src/a.ts", "docs", True), (1, "src/a.ts", "docs", False), (2, "gone", "x", True)], "saved_idx int, path string, text string, checked boolean")
    merged = checklist.merge_checklist(items, was)
    assert {r.text: r.checked for r in merged.collect()} == {"tests": False, "types": False, "docs": True}
    assert {r.text: r.checked for r in checklist.toggle_item(merged, "src/a.ts", "tests").collect()}["tests"] is True


def test_rounds(spark):
    rounds = spark.createDataFrame([], schemas.ROUNDS)
    rounds = state.start_round(state.start_round(rounds, "b", "s1", NOW), "b", "s2", NOW)
    rounds = state.mark_viewed(state.mark_viewed(rounds, "b", ["x"]), "b", ["x", "y"])
    got = {r.version: (r.sha, r.files_viewed) for r in rounds.collect()}
    assert got == {1: ("s1", []), 2: ("s2", ["x", "y"])}
    assert state.latest_round(rounds).first().version == 2 and state.next_version(rounds).first().next_version == 3
    closed = state.latest_round(state.close_session(rounds, "b", ["z"], 4)).first()
    assert (closed.files_viewed, closed.notes_count) == (["z"], 4)
    files = spark.createDataFrame([("c", "x"), ("c", "q")], "change_id string, path string")
    assert tuple(state.progress(files, state.viewed_files(files, rounds)).first()) == ("c", 1, 2, 0.5)


def test_notes(spark):
    notes = spark.createDataFrame([], schemas.NOTES)
    notes = state.add_note(state.add_note(notes, "b", "f", 3, "hm", NOW), "b", "f", None, "ok", NOW)
    ids = [r.id for r in notes.orderBy("id").collect()]
    assert ids == ["1709251200000_0_1", "1709251200000_3_0"]
    assert [r.line for r in state.note_lines(notes).collect()] == [3]
    assert state.notes_for(notes, "f").count() == 2 and state.delete_note(notes, ids[0]).count() == 1


def test_inbox(spark):
    raw = spark.read.json(spark.sparkContext.parallelize(['{"number":1,"title":null,"user":{"login":"me"},"merged_at":null,"closed_at":null,"draft":null,"head":{"ref":"h"},"base":{"ref":"b"},"html_url":"u","created_at":"2024-02-01T00:00:00Z","updated_at":null,"additions":3,"deletions":1,"labels":[{"name":"l"}]}', '{"number":2,"title":"t","user":null,"merged_at":"2024-01-01","closed_at":"2024-01-01","draft":true,"labels":null}', '{"number":3,"title":"t3","user":{"login":"you"},"closed_at":"2024-01-01"}']))
    prs = inbox.pull_requests(raw, F.lit(NOW))
    rows = {r.number: r for r in prs.collect()}
    assert [(rows[i].state, rows[i].author, rows[i].draft, rows[i].title) for i in (1, 2, 3)] == [("Open", "me", False, ""), ("Merged", "", True, "t"), ("Closed", "you", False, "t3")]
    assert rows[1].labels == ["l"] and rows[1].updated_at == NOW and rows[1].review_status == "None"
    assert [(r.number, r.box) for r in pipeline.pull_request_inbox(prs, "me").collect()] == [(1, "mine")]
    line = prs.filter("number = 1").select(inbox.line(F.lit(NOW), 4)).first()[0]
    assert line == "  #1           [no review]      +3/-1 0m ago"


@pytest.mark.parametrize(("url", "want"), [("git@github.com:o/r.git", ("o", "r")), ("https://github.com/o/r/", ("o", "r")), ("https://github.com/o/r.git", ("o", "r")), ("https://github.com/o/a/b", ("o", "a/b")), ("https://gitlab.com/o/r", None), ("https://github.com/o", None)])
def test_addresses(spark, url, want):
    got = spark.range(1).select(inbox.repository_of(F.lit(url)).alias("r")).first().r
    assert (got and tuple(got)) == want


def test_queue(spark):
    df = spark.createDataFrame([("c", 0, "a/B.ts", "Source", 1, 0, 1.0, 2, 1), ("c", 1, "x.ts", "Source", 50, 0, 1.0, 50, 0), ("c", 2, "l", "Lock", 9, 9, 1.0, 9, 9)], "change_id string, file_idx int, path string, category string, new_logic long, modified_logic long, risk double, additions long, deletions long")
    ranked = queue.ranked(queue.score(df))
    assert [r.path for r in ranked.orderBy("position").collect()] == ["x.ts", "a/B.ts", "l"]
    assert [r.path for r in queue.search(ranked, "b.T").collect()] == ["a/B.ts"] and queue.search(ranked, "").count() == 3
    assert [r.path for r in queue.page(ranked, 1, 1).collect()] == ["a/B.ts"]
    changes = spark.createDataFrame([("c",), ("none",)], "change_id string")
    moved = spark.createDataFrame([("c", 6)], "change_id string, moved_lines long")
    got = {r.change_id: r for r in queue.summary(ranked, moved, changes).collect()}
    assert (got["c"].total_files, got["c"].logic_lines_added, got["c"].deep, got["c"].skip, got["c"].moved_lines, got["c"].estimated_review_minutes) == (3, 69, 1, 1, 6, 3)
    assert (got["none"].total_files, got["none"].estimated_review_minutes) == (0, 0)
    assert {r.change_id: r.estimated_review_minutes for r in queue.raw_summary(ranked, changes).collect()} == {"c": 4, "none": 1}


def repository(path):
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    path.mkdir()
    run("init", "-q", "-b", "main")
    (path / "src").mkdir()
    (path / "src/a.py").write_text("import os\n\ndef f(a):\n    return a\n\ndef gone():\n    pass\n")
    (path / "src/b.ts").write_text('import { f } from "./c";\n')
    (path / ".gitignore").write_text("ignored.py\n")
    run("add", "-A"), run("commit", "-qm", "one")
    run("checkout", "-qb", "topic")
    (path / "src/a.py").write_text("import os\n\ndef f(a, b):\n    return a + b\n")
    (path / "src/c.ts").write_text("export const f = (x: number) => x;\n")
    (path / "ignored.py").write_text("x")
    run("add", "-A"), run("commit", "-qm", "two")
    return str(path)


def test_repository_review(spark, tmp_path):
    repo = repository(tmp_path / "r")
    assert (git.current_branch(repo), git.detect_base(repo), git.is_clean(repo), git.discover(repo + "/src")) == ("topic", "main", True, repo)
    with pytest.raises(git.GitError, match="nope"):
        git.resolve(repo, "nope")
    base, head = (git.snapshot(spark, repo, r).withColumn("change_id", F.lit("c")) for r in ("main", "topic"))
    commits = git.commits(spark, repo)
    assert sorted((r.author, r.path) for r in commits.collect()) == [("Ann", ".gitignore"), ("Ann", "src/a.py"), ("Ann", "src/a.py"), ("Ann", "src/b.ts"), ("Ann", "src/c.ts")]
    out = pipeline.review(base, head, commits, F.lit(datetime.now()))
    files = {r.path: r for r in out["files"].collect()}
    assert {p: (r.status, r.additions, r.deletions) for p, r in files.items()} == {"src/a.py": ("Modified", 2, 5), "src/c.ts": ("Added", 1, 0)}
    assert {(r.name, r.change) for r in out["function_changes"].collect()} == {("f", "SignatureChanged"), ("gone", "Deleted")}
    nested = saved.nested_diff(out["files"], out["hunks"].join(out["spans"], ["change_id", "file_idx", "hunk_idx"]), out["lines"], out["summary"], "main", "topic").first()
    assert {f.path for f in nested.files} == set(files) and nested.summary.total_files == 2 and nested.files[0].hunks[0].lines
    tree = git.worktree(spark, repo).withColumn("change_id", F.lit("c"))
    assert sorted(r.path for r in tree.collect()) == ["src/a.py", "src/b.ts", "src/c.ts"]
    g = pipeline.dependency_graph(tree)
    assert [(r.src, r.dst) for r in g["edges"].collect()] == [("src/b.ts", "src/c.ts")]
    assert {r.path: r.severity for r in pipeline.impacts(out["files"].select("change_id", "path"), g).collect()} == {"src/b.ts": "direct"}
    plan = pipeline.split_change(out["files"], g)
    assert plan["members"].count() == 2
    assert {r.category for r in pipeline.ghosts(out["files"], g).collect()} == {"MissingTest"}


def test_state_files(spark, tmp_path):
    where = saved.init_folder(saved.init_folder(str(tmp_path / "s")))
    assert saved.read_state(spark, where + "/reviews/r", schemas.ROUNDS).isEmpty()
    one = state.start_round(spark.createDataFrame([], schemas.ROUNDS), "a/b", "s", NOW)
    saved.write_state(one, where + "/reviews/r")
    saved.write_state(state.start_round(spark.createDataFrame([], schemas.ROUNDS), "c", "t", NOW), where + "/reviews/r")
    assert {r.branch: r.sha for r in saved.read_state(spark, where + "/reviews/r", schemas.ROUNDS).collect()} == {"a/b": "s", "c": "t"}
    assert saved.load_config(where + "/none.yaml") == saved.Config()
    config = saved.config_from({"review": {"move_detection_min_lines": 5, "other": 1}, "split": None})
    assert (config.review.move_detection_min_lines, config.review.move_similarity_threshold, config.split.target_group_size) == (5, 0.85, 150)
    saved.save_config(config, where + "/c.yaml")
    assert saved.load_config(where + "/c.yaml") == config
    (tmp_path / "rules.yaml").write_text("rules:\n- when: '*.ts'\n  checks: [a, b]\n")
    assert saved.load_rules(str(tmp_path / "rules.yaml")) == [("*.ts", ["a", "b"])] and saved.load_rules("/none") == []


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame(pd.DataFrame({"change_id": ["c"] * 3, "path": ["a", "a", "b"], "version": [1, 2, 1], "digest": ["x", "y", "z"]})).selectExpr("change_id", "path", "cast(version as int) version", "digest").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("change_id string, path string, version int, digest string").parquet(str(src))
    q = streams.round_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable(), q.stop()
    assert sorted((r.path, r.version, r.state) for r in spark.table("states").collect()) == [("a", 1, "new"), ("a", 2, "modified"), ("b", 1, "new")]
    commits = tmp_path / "commits"
    spark.createDataFrame([("a", "x", NOW), ("a", "y", NOW), ("b", "x", NOW + timedelta(days=60))], "path string, author string, ts timestamp").coalesce(1).write.parquet(str(commits))
    stream = spark.readStream.schema("path string, author string, ts timestamp").parquet(str(commits))
    q = streams.sliding_churn(stream, 2).writeStream.format("memory").queryName("churn").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable(), q.stop()
    assert {(r.path, r.commit_count, r.author_count) for r in spark.table("churn").collect()} == {("a", 2, 2), ("b", 1, 1)}
