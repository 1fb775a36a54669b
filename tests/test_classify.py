from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import classify, text
from deltaloom.operators import hunks

CATEGORIES = {
    "package-lock.json": "Lock", "a/go.sum": "Lock", "src/api.generated.ts": "Generated", "x/index.d.ts": "Generated", "a/codegen/x.ts": "Generated", "a/generated/x.ts": "Generated", "generated/x.ts": "Source", "a.pb.go": "Generated",
    "a/__snapshots__/b.js": "Snapshot", "a.snap": "Snapshot", "a/b.test.ts": "Test", "b.spec.js": "Test", "b_test.go": "Test", "tests/x.py": "Test", "a/test/x.py": "Test", "__tests__/x.ts": "Source", "src/types/a.ts": "TypeDefinition", "types/a.ts": "Source",
    "a.types.ts": "TypeDefinition", "vite.config.ts": "Config", ".eslintrc.json": "Config", "tsconfig.build.json": "Config", ".env.local": "Config", "Makefile": "Config", "docker-compose.yml": "Config", "a.scss": "Style", "a.styled.tsx": "Style",
    "README.md": "Documentation", "LICENSE": "Documentation", "src/main.rs": "Source",
}


def test_file_categories(spark):
    rows = spark.createDataFrame([(p,) for p in CATEGORIES], "path string").select("path", classify.file_category(F.col("path")).alias("c")).collect()
    assert {r.path: r.c for r in rows} == CATEGORIES


def test_paths(spark):
    paths = ["src/a.test.ts", ".env", "x/.gitignore", "Makefile", "a/b.tar.gz"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(text.file_name(F.col("path")), text.extension(F.col("path")), text.stem(F.col("path")), text.directory(F.col("path"))).collect()
    assert [tuple(r) for r in rows] == [("a.test.ts", "ts", "a.test", "src"), (".env", "", ".env", ""), (".gitignore", "", ".gitignore", "x"), ("Makefile", "", "Makefile", ""), ("b.tar.gz", "gz", "b.tar", "a")]


def test_normalize_path(spark):
    cases = {"src/utils/../helpers": "src/helpers", "./a/./b": "a/b", "../x": "x", "a/../../b": "b", "a//b/": "a/b", "..": ""}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", text.normalize_path(F.col("path")).alias("n")).collect()
    assert {r.path: r.n for r in rows} == cases


def test_lines_and_trim(spark):
    rows = spark.createDataFrame([("a\r\n\n b\n",), ("",), ("x",), ("\n",)], "t string").select(text.lines(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [["a", "", " b"], [], ["x"], [""]]
    row = spark.createDataFrame([(" \t x 　",)], "t string").select(text.trim_all(F.col("t")), text.trim_start(F.col("t"))).first()
    assert tuple(row) == ("x", "x 　")


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("*.ts", "src/a.ts", True), ("src/**", "src/a/b.py", True), ("src/**", "src", False), ("**/*.rs", "a.rs", True), ("**/*.rs", "x/y/a.rs", True), ("a?c", "abc", True), ("a?c", "ac", False), ("*.{ts,py}", "x.py", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False)],
)
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "path string").select(F.expr("path rlike pattern") if False else F.col("path").rlike(text.glob_to_regex(glob))).first()[0] is hit


def test_invalid_globs():
    assert [text.glob_to_regex(g) for g in ("[a", "{a", "a}", "a\\")] == [None] * 4


@pytest.mark.parametrize(("category", "new", "modified", "risk", "score", "bucket"), [("Source", 50, 0, 1.0, 150.0, "Deep"), ("Source", 10, 0, 1.0, 30.0, "Scan"), ("Source", 2, 0, 1.0, 6.0, "Glance"), ("Lock", 0, 100, 1.0, 0.0, "Skip"), ("Test", 0, 10, 2.0, 20.0, "Glance"), ("Source", 0, 0, 3.0, 0.0, "Skip"), ("Source", 0, 50, 1.0, 100.0, "Scan")])
def test_scores(spark, category, new, modified, risk, score, bucket):
    df = spark.createDataFrame([(category, new, modified, risk)], "c string, n long, m long, r double")
    got = df.select(classify.priority_score(F.col("n"), F.col("m"), F.col("c"), F.col("r")).alias("s")).select("s", classify.priority(F.col("s"))).first()
    assert tuple(got) == (score, bucket)


def _lines(spark, *hunk_lines):
    return spark.createDataFrame([("c", 0, h, i, k, t) for h, ls in enumerate(hunk_lines) for i, (k, t) in enumerate(ls)], "change_id string, file_idx int, hunk_idx int, line_idx int, kind string, content string")


def test_hunk_classes(spark):
    df = _lines(
        spark,
        [("Added", "  \n"), ("Context", "x")],
        [("Context", "x")],
        [("Added", "import a"), ("Removed", "from a import b"), ("Added", "")],
        [("Added", "x = 1"), ("Added", "")],
        [("Added", "x = 1"), ("Removed", " ")],
        [("Added", "x = 1"), ("Added", "use a::b;")],
        [("Added", "export { a } from 'b'"), ("Added", "#include <x>"), ("Added", "const y = require('z')")],
    )
    got = {r.hunk_idx: r.classification for r in hunks.classify_hunks(df).collect()}
    assert got == {0: "WhitespaceOnly", 1: "WhitespaceOnly", 2: "ImportOnly", 3: "NewLogic", 4: "ModifiedLogic", 5: "ModifiedLogic", 6: "ImportOnly"}


def test_logic_lines(spark):
    df = _lines(spark, [("Added", "x"), ("Added", ""), ("Added", "y")], [("Added", "x"), ("Removed", "y")], [("Added", "import x")])
    row = hunks.logic_lines(df, hunks.classify_hunks(df)).first()
    assert (row.new_logic, row.modified_logic) == (2, 1)


def test_small_formats(spark):
    one = spark.range(1)
    now = datetime(2024, 1, 10)
    ages = {timedelta(minutes=5): ("5m ago", "5m ago"), timedelta(hours=3): ("3h ago", "3h ago"), timedelta(days=2, hours=3): ("2d ago", "2d ago"), timedelta(seconds=3): ("0m ago", "just now")}
    for d, want in ages.items():
        assert tuple(one.select(classify.age(F.lit(now - d), F.lit(now)), classify.age(F.lit(now - d), F.lit(now), "screen")).first()) == want
    row = one.select(classify.truncate(F.lit("abcdef"), 6), classify.truncate(F.lit("abcdefg"), 6), classify.sanitize_branch(F.lit("special!@#chars")), classify.sanitize_branch(F.lit("-leading-dash")), classify.branch_file(F.lit("a/b/c"))).first()
    assert tuple(row) == ("abcdef", "abc...", "special---chars", "leading-dash", "a__b__c")
    got = one.select(classify.semantic_summary(F.lit(2), F.lit(0), F.lit(1)), classify.semantic_summary(F.lit(0), F.lit(0), F.lit(0)), classify.note_id(F.lit(datetime(1970, 1, 1, 0, 0, 1)), F.lit(None).cast("int"), F.lit(4))).first()
    assert tuple(got) == ("+2fn -1fn", None, "1000_0_4")
