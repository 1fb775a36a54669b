import pytest
from pyspark.sql import functions as F

from deltaloom.operators import ghost, graph, split


def edges(spark, *pairs):
    return spark.createDataFrame([("c", a, b, i) for i, (a, b) in enumerate(pairs)], "change_id string, src string, dst string, edge_no long")


def changed(spark, *paths):
    return spark.createDataFrame([("c", p) for p in paths], "change_id string, path string")


@pytest.mark.parametrize(
    ("pairs", "start", "depth", "want"),
    [
        ([("a", "b"), ("b", "c")], ["c"], 10, {"b": 1, "a": 2}),
        ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], ["d"], 10, {"b": 1, "c": 1, "a": 2}),
        ([("a", "b"), ("b", "c"), ("c", "d")], ["d"], 1, {"c": 1}),
        ([("a", "b"), ("b", "a")], ["a"], 10, {"b": 1}),
        ([("a", "b"), ("b", "c"), ("c", "d")], ["d", "b"], 2, {"c": 1, "a": 1}),
        ([("a", "b")], ["x"], 3, {}),
    ],
)
def test_impact(spark, pairs, start, depth, want):
    got = graph.impact(edges(spark, *pairs), changed(spark, *start), depth)
    assert {r.path: r.depth for r in got.collect()} == want


def test_severity_and_counts(spark):
    got = graph.impact(edges(spark, ("a", "b"), ("b", "c")), changed(spark, "c"))
    assert {r.path: r.s for r in got.withColumn("s", graph.severity(F.col("depth"))).collect()} == {"b": "direct", "a": "transitive (depth 2)"}
    assert tuple(graph.impact_counts(got).first())[1:] == (1, 1, 2)


def test_cycles(spark):
    got = graph.cycles(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("y", "x"), ("x", "a"))).collect()
    assert sorted((r.component, r.path) for r in got) == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")]


def test_levels_and_order(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    nodes = changed(spark, "a", "b", "c", "z")
    levels = graph.topological_levels(nodes, e)
    assert {r.path: r.level for r in levels.collect()} == {"c": 0, "z": 0, "b": 1, "a": 2}
    cyclic = edges(spark, ("a", "b"), ("b", "a"), ("c", "a"))
    order = graph.file_order(graph.topological_levels(changed(spark, "a", "b", "c", "d"), cyclic), graph.cycles(cyclic))
    assert [r.path for r in order.orderBy("k1", "k2", "path").collect()] == ["a", "b", "c", "d"]


def test_neighbours(spark):
    e = edges(spark, ("a", "b"), ("a", "b"), ("c", "b"))
    assert sorted(r.path for r in graph.dependents(e, "b").collect()) == ["a", "a", "c"]
    assert [r.path for r in graph.dependencies(e, "c").collect()] == ["b"] and graph.dependencies(e, "nope").isEmpty()
    assert graph.has_dependency(e, "a", "b") and not graph.has_dependency(e, "b", "a")


def test_resolution(spark):
    paths = ["src/a.ts", "src/utils/index.ts", "src/helpers.ts", "pkg/__init__.py", "pkg.py", "src/b.tsx", "src/b.js", "m/mod.rs", "lib.rs"]
    asked = [("src/a.ts", "TypeScript", "./utils", "src/utils/index.ts"), ("src/x/y.ts", "TypeScript", "../helpers", "src/helpers.ts"), ("src/a.ts", "TypeScript", "./b", "src/b.tsx"), ("src/a.ts", "TypeScript", "./b.js", "src/b.js"), ("src/a.ts", "TypeScript", "react", None), ("pkg/x.py", "Python", ".", "pkg.py"), ("pkg/x.py", "Python", "..models", None), ("lib.rs", "Rust", "./m", "m/mod.rs"), ("a.go", "Unknown", "./lib.rs", None)]
    imports = spark.createDataFrame([("c", p, i, lang, s) for i, (p, lang, s, _) in enumerate(asked)], "change_id string, path string, import_idx int, language string, source string")
    got = graph.resolve_imports(imports, changed(spark, *paths))
    assert {r.import_idx: r.resolved_path for r in got.collect()} == {i: x[3] for i, x in enumerate(asked)}


def files(spark, *rows):
    return spark.createDataFrame([("c", *r) for r in rows], "change_id string, path string, status string, category string")


def test_ghosts(spark):
    fs = files(spark, ("src/utils.ts", "Deleted", "Source"), ("src/app.ts", "Modified", "Source"), ("src/a.test.ts", "Modified", "Test"), ("hub.ts", "Modified", "Config"))
    parsed = changed(spark, "src/utils.ts", "src/app.ts", "tests/my_app.test.ts", "src/a.test.ts")
    e = edges(spark, ("src/app.ts", "src/utils.ts"), ("src/app.ts", "src/utils.ts"), *[(f"m{i % 3}.ts", "hub.ts") for i in range(6)])
    got = sorted((r.path, r.category, r.related_file, r.dependent_count) for r in ghost.ghost_findings(fs, parsed, e).collect())
    assert got == [("hub.ts", "HighImpact", None, 6), ("src/utils.ts", "BrokenImport", "src/app.ts", None), ("src/utils.ts", "BrokenImport", "src/app.ts", None), ("src/utils.ts", "MissingTest", None, None)]
    assert ghost.high_impact(fs, e, distinct_dependents=True).isEmpty()
    assert tuple(ghost.finding_counts(ghost.ghost_findings(fs, parsed, e)).first()) == ("c", 2, 1, 1)


def plan(spark, rows, e, target):
    fs = spark.createDataFrame([("c", p, c, n, 0, n) for p, c, n in rows], "change_id string, path string, category string, additions long, deletions long, logic_lines long")
    nodes = changed(spark, *[r[0] for r in rows])
    order = graph.file_order(graph.topological_levels(nodes, e), graph.cycles(e))
    return split.split_plan(fs, order, e, target)


def test_split_follows_dependencies(spark):
    out = plan(spark, [("src/a.ts", "Source", 100), ("src/b.ts", "Source", 100), ("Cargo.lock", "Lock", 9)], edges(spark, ("src/a.ts", "src/b.ts")), 80)
    assert {r.path: r.group_index for r in out["members"].collect()} == {"src/b.ts": 0, "src/a.ts": 1}
    assert [(r.group_index, r.depends_on) for r in out["depends"].collect()] == [(1, 0)]
    assert [r.path for r in out["skipped"].collect()] == ["Cargo.lock"] and out["issues"].isEmpty()
    assert {r.group_index: r.name for r in out["groups"].collect()} == {0: "src", 1: "src"}


def test_budget(spark):
    out = plan(spark, [(f"d/f{i}.ts", "Source", n) for i, n in enumerate([60, 60, 60, 500, 0, 10])], edges(spark), 150)
    assert [r.group_index for r in out["members"].orderBy("position").collect()] == [0, 0, 1, 2, 3, 3]


def test_issues_name_later_groups(spark):
    members = spark.createDataFrame([("c", 0, 1, "a"), ("c", 1, 2, "b"), ("c", 2, 3, "d")], "change_id string, group_index int, position int, path string")
    e = edges(spark, ("a", "b"), ("b", "a"), ("d", "a"), ("d", "out"))
    depends = split.group_dependencies(members, e)
    got = split.plan_issues(members, e, depends).collect()
    assert [(r.group_index, r.file, r.missing_dep) for r in got] == [(0, "a", "b")] and got[0].message.startswith("File 'a' in group 0 depends on 'b' which is in group 1")


@pytest.mark.parametrize(("paths", "name"), [(["src/core/parser/lexer.rs", "src/core/parser/ast.rs"], "core/parser"), (["main.rs"], "group-3"), (["a/x", "b/y"], "group-3"), (["src/core/x", "src/core/p/y"], "core"), (["src/a/x", "src/ab/y"], "a"), (["src/ab/x", "src/ac/y"], "src"), (["src/x", "main.rs"], "group-3")])
def test_group_names(spark, paths, name):
    df = spark.createDataFrame([("c", 3, i, p) for i, p in enumerate(paths)], "change_id string, group_index int, position int, path string")
    assert split.group_names(df).first().name == name


def test_branches(spark):
    groups = spark.createDataFrame([("c", i, f"group {i}", 1) for i in range(3)], "change_id string, group_index int, name string, total_files long")
    depends = spark.createDataFrame([("c", 2, 0)], "change_id string, group_index int, depends_on int")
    got = [(r.branch_name, r.parent, r.pr_base, r.pr_title) for r in split.branch_plan(groups, depends).orderBy("group_index").collect()]
    assert got == [("split/part-01-group-0", "main", "main", "[1/3] group 0"), ("split/part-02-group-1", "main", "split/part-01-group-0", "[2/3] group 1"), ("split/part-03-group-2", "split/part-01-group-0", "split/part-02-group-1", "[3/3] group 2")]


def test_large_changes_are_solved_in_steps(spark, monkeypatch):
    """Levels and cycles are the same however many edges fit in a task."""
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("e", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("q", "missing")]
    e = edges(spark, *pairs)
    nodes = changed(spark, *"abcdexyzwsq")
    want = sorted(map(str, graph.topological_levels(nodes, e).collect())), sorted(map(str, graph.cycles(e).collect()))
    levels = {r.path: r.level for r in graph.topological_levels(nodes, e).collect()}
    assert levels == {"d": 0, "c": 1, "b": 2, "a": 3, "e": 4, **dict.fromkeys("xyzwsq")}
    monkeypatch.setattr(graph, "GROUP_EDGES", 3)
    assert (sorted(map(str, graph.topological_levels(nodes, e).collect())), sorted(map(str, graph.cycles(e).collect()))) == want
