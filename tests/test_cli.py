import json

import pytest
from test_rounds import repository

from deltaloom import __main__ as cli


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    return repository(tmp_path_factory.mktemp("cli") / "r")


def call(spark, repo, *argv):
    return cli.run(spark, cli.arguments([*argv, "--repo", repo]))


def test_review(spark, repo):
    d = json.loads(call(spark, repo, "review", "--json")[0])
    assert {f["path"] for f in d["files"]} == {"src/a.py", "src/c.ts"} and d["summary"]["total_files"] == 2 and d["base_ref"] == "main"


def test_ghost(spark, repo):
    text, code = call(spark, repo, "ghost")
    assert code == 0 and "WARNINGS (2):" in text and "[MISSING_TEST] src/a.py — Changed source file `src/a.py` has no corresponding test file" in text and text.endswith("Summary: 0 errors, 2 warnings, 0 info")


def test_impact(spark, repo):
    text, _ = call(spark, repo, "impact", "src/c.ts")
    assert "Direct dependents (1):\n  src/b.ts" in text and text.endswith("Total: 1 files affected")
    d = json.loads(call(spark, repo, "impact", "none.ts", "--json")[0])
    assert (d["total"], d["impacted"]) == (0, [])


def test_split(spark, repo):
    text, _ = call(spark, repo, "split", "--dry-run", "--prefix", "p")
    assert text.startswith("Split plan: 1 groups, 0 skipped files") and "Validation: OK" in text and "p/part-01-src (2 files)" in text


def test_inbox(spark, repo, tmp_path):
    pulls = [{"number": n, "title": f"t{n}", "user": {"login": who}, "merged_at": None, "closed_at": None, "draft": False, "head": {"ref": "h"}, "base": {"ref": "b"}, "html_url": "u", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "additions": 1, "deletions": 2, "labels": [{"name": "x"}]} for n, who in ((1, "me"), (2, "you"))]
    (tmp_path / "p.json").write_text(json.dumps(pulls))
    text, _ = call(spark, repo, "inbox", "--pulls", str(tmp_path / "p.json"), "--user", "me")
    assert "Your PRs (1):\n  #1     t1" in text and "Review Requested (1):\n  #2     t2" in text
    d = json.loads(call(spark, repo, "inbox", "--pulls", str(tmp_path / "p.json"), "--user", "me", "--json")[0])
    assert [p["number"] for p in d["my_prs"]] == [1] and [p["number"] for p in d["review_prs"]] == [2]


def test_stubs(spark, repo):
    assert call(spark, repo, "stats") == ("stats: not implemented", 0) and call(spark, repo, "notes")[1] == 0
