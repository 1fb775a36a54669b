"""Registered queries of the code-review operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import stem
from ..operators import checklist, churn, diff, ghost, graph, hunks, inbox, interdiff, moves, queue, semantic, split, state
from ..sources.state import nested_diff
from . import adapters as A
from . import pipeline

AS_OF = datetime(2024, 1, 31)
DAYS = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _when(subject: str, pairs: dict) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + " END"


def _rule(kind: str, values: tuple[str, ...]) -> str:
    if kind == "name starts and ends":
        return f"(starts_with(name, '{values[0]}') AND ends_with(name, '{values[1]}'))"
    subject, test = kind.split()
    column = {"name": "name", "path": "path", "extension": "ext"}[subject]
    each = {"is": "{c} = '{v}'", "has": "contains({c}, '{v}')", "starts": "starts_with({c}, '{v}')", "ends": "ends_with({c}, '{v}')"}[test]
    return "(" + " OR ".join(each.format(c=column, v=v) for v in values) + ")"


CATEGORY_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(_rule(k, v) for k, v in rules)} THEN '{category}'" for category, rules in classify.CATEGORY_RULES) + " ELSE 'Source' END"
WEIGHT_SQL = _when("category", classify.CATEGORY_WEIGHTS)
NAMED_SQL = f"{A.FILES_SQL}, named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1) AS ext FROM files), classed AS (SELECT *, {CATEGORY_SQL} AS category FROM named)"
TRIM = r"regexp_replace(content, '^[\s\p{Z}]+', '')"
HUNKS_SQL = f"""{A.LINES_SQL}, marked AS (SELECT *, {TRIM} <> '' AS filled, (starts_with({TRIM}, 'import ') OR (starts_with({TRIM}, 'from ') AND contains({TRIM}, ' import ')) OR contains({TRIM}, 'require(') OR starts_with({TRIM}, 'use ') OR starts_with({TRIM}, '#include') OR (starts_with({TRIM}, 'export ') AND contains({TRIM}, ' from '))) AS imports FROM lines),
 counted AS (SELECT change_id, file_idx, hunk_idx, count(*) FILTER (kind <> 'Context' AND filled) AS f, count(*) FILTER (kind <> 'Context' AND filled AND imports) AS i, count(*) FILTER (kind = 'Removed') AS r FROM marked GROUP BY ALL),
 classes AS (SELECT change_id, file_idx, hunk_idx, CASE WHEN f = 0 THEN 'WhitespaceOnly' WHEN i = f THEN 'ImportOnly' WHEN r = 0 AND i = 0 THEN 'NewLogic' ELSE 'ModifiedLogic' END AS classification FROM counted)"""
#: Words as lines, four to a hunk, removed from every other document and added to the rest, all in one change.
ONE_SQL = f"""words_ AS (SELECT doc_id, unnest(string_split(text, ' ')) AS line, unnest(range(len(string_split(text, ' ')))) AS line_idx FROM documents WHERE text <> ''),
 lines AS (SELECT 'all' AS change_id, CAST(doc_id AS INT) AS file_idx, CAST(line_idx // 4 AS INT) AS hunk_idx, CAST(line_idx AS INT) AS line_idx, CASE WHEN doc_id % 2 = 0 THEN 'Added' ELSE 'Removed' END AS kind, line AS content FROM words_)"""
BLOCKS_SQL = f"""{ONE_SQL}, islands AS (SELECT *, line_idx - row_number() OVER (PARTITION BY change_id, file_idx, hunk_idx, kind ORDER BY line_idx) AS island FROM lines WHERE kind IN ('Added', 'Removed')),
 blocks AS (SELECT change_id, file_idx, hunk_idx, kind, CAST(min(line_idx) AS INT) AS line_start, CAST(max(line_idx) + 1 AS INT) AS line_end, coalesce(string_agg({TRIM}, chr(10) ORDER BY line_idx) FILTER ({TRIM} <> ''), '') AS body FROM islands GROUP BY change_id, file_idx, hunk_idx, kind, island HAVING count(*) >= 3),
 nth AS (SELECT * EXCLUDE (body), md5(body) AS digest, row_number() OVER (PARTITION BY change_id, md5(body), kind ORDER BY file_idx, hunk_idx, line_start) AS n FROM blocks),
 moves AS (SELECT o.change_id, o.file_idx AS old_file_idx, o.hunk_idx AS old_hunk_idx, o.line_start AS old_line_start, o.line_end AS old_line_end, a.file_idx AS new_file_idx, a.hunk_idx AS new_hunk_idx, a.line_start AS new_line_start, a.line_end AS new_line_end
   FROM nth o JOIN nth a ON o.change_id = a.change_id AND o.digest = a.digest AND o.n = a.n AND o.kind = 'Removed' AND a.kind = 'Added')"""
CHURN_SQL = f"{A.COMMITS_SQL}, churn AS (SELECT f.change_id, f.path, count(*) AS commit_count, count(DISTINCT author) AS author_count FROM files f JOIN commits c ON f.path = c.path WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL {DAYS} DAY GROUP BY ALL), risks AS (SELECT *, least(greatest(commit_count / avg(commit_count) OVER (PARTITION BY change_id), 0.5), 3.0) AS risk_multiplier FROM churn)"
RELABELLED_SQL = """moved_lines_ AS (SELECT change_id, old_file_idx AS file_idx, old_hunk_idx AS hunk_idx, old_line_start AS s, old_line_end AS e FROM moves UNION ALL SELECT change_id, new_file_idx, new_hunk_idx, new_line_start, new_line_end FROM moves),
 relabelled AS (SELECT l.*, m.s IS NOT NULL AS moved FROM lines l LEFT JOIN moved_lines_ m ON l.change_id = m.change_id AND l.file_idx = m.file_idx AND l.hunk_idx = m.hunk_idx AND l.line_idx >= m.s AND l.line_idx < m.e)"""
QUEUE_SQL = f"""{NAMED_SQL}, {HUNKS_SQL}, {CHURN_SQL},
 logic AS (SELECT change_id, file_idx, count(*) FILTER (classification = 'NewLogic' AND kind = 'Added' AND filled) AS n, count(*) FILTER (classification = 'ModifiedLogic' AND kind = 'Added' AND filled) AS m FROM marked JOIN classes USING (change_id, file_idx, hunk_idx) GROUP BY ALL),
 scored AS (SELECT c.change_id, c.file_idx, c.path, c.category, coalesce(n, 0) + coalesce(m, 0) AS logic_lines, CASE WHEN {WEIGHT_SQL} = 0 THEN 0.0 ELSE CAST(3 * coalesce(n, 0) + 2 * coalesce(m, 0) AS DOUBLE) * CAST({WEIGHT_SQL} AS DOUBLE) * coalesce(risk_multiplier, 1.0) END AS priority_score
   FROM classed c LEFT JOIN logic l ON c.change_id = l.change_id AND c.file_idx = l.file_idx LEFT JOIN risks r ON c.change_id = r.change_id AND c.path = r.path),
 queue AS (SELECT *, CASE WHEN priority_score > 100 THEN 'Deep' WHEN priority_score > 20 THEN 'Scan' WHEN priority_score > 0 THEN 'Glance' ELSE 'Skip' END AS priority FROM scored)"""


def _one_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.posexplode(F.split("text", " ")).alias("line_idx", "content"))
    kind = F.when(F.col("doc_id") % 2 == 0, "Added").otherwise("Removed")
    return rows.select(F.lit("all").alias("change_id"), F.col("doc_id").cast("int").alias("file_idx"), F.floor(F.col("line_idx") / 4).cast("int").alias("hunk_idx"), "line_idx", kind.alias("kind"), "content")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, lines = A.files(spark, sf_dir), A.lines(spark, sf_dir)
    counts = hunks.logic_lines(lines, hunks.classify_hunks(lines))
    risk = churn.file_churn(A.commits(spark, sf_dir), files, F.lit(AS_OF), DAYS)
    classed = files.withColumn("category", classify.file_category(F.col("path"))).join(counts, ["change_id", "file_idx"], "left").fillna(0, ["new_logic", "modified_logic"])
    return queue.score(churn.with_risk(classed, risk))


@query(f"WITH {NAMED_SQL} SELECT path, category, CAST({WEIGHT_SQL} AS DOUBLE) AS weight, {_when('status', classify.STATUS_CODES)} AS code, coalesce({_when('ext', classify.LANGUAGES)}, 'Unknown') AS language FROM classed")
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return A.files(spark, sf_dir).withColumn("category", classify.file_category(p)).select("path", "category", classify.category_weight(F.col("category")).alias("weight"), classify.status_code(F.col("status")).alias("code"), classify.language(p).alias("language"))


@query(f"WITH {HUNKS_SQL} SELECT * FROM classes")
def hunk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunks.classify_hunks(A.lines(spark, sf_dir))


@query(f"WITH {QUEUE_SQL} SELECT change_id, path, category, logic_lines, priority_score, priority, row_number() OVER (PARTITION BY change_id ORDER BY priority_score DESC, file_idx) AS position FROM queue")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.ranked(_scored(spark, sf_dir)).select("change_id", "path", "category", "logic_lines", "priority_score", "priority", "position")


@query(f"""WITH {QUEUE_SQL}, edits AS (SELECT change_id, file_idx, count(*) FILTER (kind = 'Added') AS a, count(*) FILTER (kind = 'Removed') AS d FROM lines GROUP BY ALL)
 SELECT change_id, count(*) AS total_files, CAST(sum(coalesce(a, 0)) AS BIGINT) AS total_additions, CAST(sum(coalesce(d, 0)) AS BIGINT) AS total_deletions, CAST(sum(logic_lines) AS BIGINT) AS logic_lines_added, count(*) FILTER (priority = 'Deep') AS deep, count(*) FILTER (priority = 'Scan') AS scan, count(*) FILTER (priority = 'Glance') AS glance, count(*) FILTER (priority = 'Skip') AS skip,
   greatest(1, CAST(sum(logic_lines) // 20 AS BIGINT)) AS minutes, greatest(1, CAST(ceil((sum(coalesce(a, 0)) + sum(coalesce(d, 0))) / 20) AS BIGINT)) AS raw_minutes FROM queue LEFT JOIN edits USING (change_id, file_idx) GROUP BY change_id""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = diff.with_counts(_scored(spark, sf_dir), A.lines(spark, sf_dir))
    none = spark.createDataFrame([], "change_id string, moved_lines long")
    done = queue.summary(scored, none, scored).withColumnRenamed("estimated_review_minutes", "minutes").drop("moved_lines")
    return done.join(queue.raw_summary(scored, scored).select("change_id", F.col("estimated_review_minutes").alias("raw_minutes")), "change_id")


@query(f"WITH {A.FILES_SQL}, {CHURN_SQL} SELECT * FROM risks")
def churn_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.file_churn(A.commits(spark, sf_dir), A.files(spark, sf_dir), F.lit(AS_OF), DAYS)


@query(f"WITH {BLOCKS_SQL} SELECT * FROM moves")
def exact_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.exact_moves(moves.blocks(_one_change(spark, sf_dir))).drop("digest")


@query(f"WITH {BLOCKS_SQL} SELECT change_id, CAST(sum(old_line_end - old_line_start + new_line_end - new_line_start) AS BIGINT) AS moved_lines FROM moves GROUP BY change_id")
def moved_line_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.moved_lines(moves.exact_moves(moves.blocks(_one_change(spark, sf_dir))))


@query(f"WITH {BLOCKS_SQL.replace(ONE_SQL, HUNKS_SQL.replace(A.LINES_SQL, ONE_SQL))}, {RELABELLED_SQL} SELECT change_id, file_idx, hunk_idx, CASE WHEN count(*) FILTER (kind <> 'Context') > 0 AND count(*) FILTER (moved AND kind <> 'Context') = count(*) FILTER (kind <> 'Context') THEN 'Moved' ELSE any_value(classification) END AS classification FROM relabelled JOIN classes USING (change_id, file_idx, hunk_idx) GROUP BY ALL")
def moved_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _one_change(spark, sf_dir)
    exact = moves.exact_moves(moves.blocks(lines)).withColumn("edited", F.lit(False))
    return hunks.relabel_hunks_by_moves(hunks.classify_hunks(lines), lines, exact)


ROUND_SQL = """was AS (SELECT change_id, path, md5(text) AS d FROM files WHERE file_idx % 7 <> 0), now AS (SELECT change_id, path, md5(CASE WHEN file_idx % 3 = 0 THEN concat(text, ' edited') ELSE text END) AS d FROM files WHERE file_idx % 5 <> 0 OR file_idx % 7 = 0)"""
STATES_SQL = f"{A.FILES_SQL}, {ROUND_SQL}, states AS (SELECT coalesce(was.change_id, now.change_id) AS change_id, coalesce(was.path, now.path) AS path, CASE WHEN was.d IS NULL THEN 'new' WHEN now.d IS NULL THEN 'removed' WHEN was.d = now.d THEN 'unchanged' ELSE 'modified' END AS state FROM was FULL OUTER JOIN now ON was.change_id = now.change_id AND was.path = now.path)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of all documents as snapshots: some files exist in one only, some are edited; each is in one at least."""
    files = A.files(spark, sf_dir).withColumnRenamed("text", "content")
    edited = files.withColumn("content", F.when(F.col("file_idx") % 3 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    return files.filter("file_idx % 7 <> 0"), edited.filter("file_idx % 5 <> 0 or file_idx % 7 = 0")


def _round(files: DataFrame) -> DataFrame:
    lines = diff.line_rows(files, "change_id", "file_idx").select("change_id", "file_idx", F.lit(0).alias("hunk_idx"), "line_idx", F.lit("Added").alias("kind"), F.col("line").alias("content"))
    return interdiff.content_digests(lines, files)


@query(f"WITH {STATES_SQL} SELECT * FROM states")
def interdiff_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return interdiff.interdiff(_round(before), _round(after))


@query(f"WITH {STATES_SQL} SELECT change_id, file_idx, path FROM files WHERE (file_idx % 5 <> 0 OR file_idx % 7 = 0) AND (change_id, path) IN (SELECT (change_id, path) FROM states WHERE state IN ('new', 'modified'))")
def interdiff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return interdiff.only_changed(after, interdiff.interdiff(_round(before), _round(after))).select("change_id", "file_idx", "path")


@query(f"WITH {STATES_SQL} SELECT change_id, path, CASE state WHEN 'new' THEN 'Added' WHEN 'removed' THEN 'Deleted' ELSE 'Modified' END AS status FROM states WHERE state <> 'unchanged'")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed_files(*_snapshots(spark, sf_dir)).select("change_id", "path", "status")


@query()
def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_lines(diff.numbered(diff.changed_files(*_snapshots(spark, sf_dir))))


@query(f"WITH {A.FILES_SQL} SELECT change_id, path FROM files WHERE contains(lower(path), 'ui/m1')")
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.search(A.files(spark, sf_dir), "UI/m1").select("change_id", "path")


@query(f"""WITH RECURSIVE {A.CHAIN_SQL}, e AS (SELECT DISTINCT change_id, src, dst FROM edges), changed AS (SELECT change_id, path FROM chain WHERE o_orderpriority = '1-URGENT'),
 walk AS (SELECT change_id, path, 0 AS depth FROM changed UNION SELECT e.change_id, e.src, w.depth + 1 FROM walk w JOIN e ON e.change_id = w.change_id AND e.dst = w.path WHERE w.depth < 5)
 SELECT change_id, path, CAST(min(depth) AS INT) AS depth, CASE WHEN min(depth) = 1 THEN 'direct' ELSE concat('transitive (depth ', CAST(min(depth) AS VARCHAR), ')') END AS severity FROM walk WHERE (change_id, path) NOT IN (SELECT (change_id, path) FROM changed) GROUP BY change_id, path""")
def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = A.chain(spark, sf_dir)
    found = graph.impact(edges, nodes.filter("o_orderpriority = '1-URGENT'"), 5)
    return found.withColumn("severity", graph.severity(F.col("depth")))


@query(f"WITH {A.CHAIN_SQL} SELECT c.change_id, c.n AS node_count, coalesce(e.n, 0) AS edge_count FROM (SELECT change_id, count(*) AS n FROM chain GROUP BY change_id) c LEFT JOIN (SELECT change_id, count(*) AS n FROM edges GROUP BY change_id) e USING (change_id)")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = A.chain(spark, sf_dir)
    return graph.graph_counts(graph.nodes(nodes, edges), edges)


@query(f"WITH {A.CHAIN_SQL} SELECT change_id, path, CAST(rn - 1 AS INT) AS level FROM chain")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = A.chain(spark, sf_dir)
    return graph.topological_levels(nodes, edges)


@query(f"WITH RECURSIVE {A.NET_SQL}, reach AS (SELECT change_id, src, dst FROM net UNION SELECT r.change_id, r.src, n.dst FROM reach r JOIN net n ON n.change_id = r.change_id AND n.src = r.dst), same AS (SELECT a.change_id, a.src AS path, a.dst AS other FROM reach a JOIN reach b ON a.change_id = b.change_id AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) SELECT change_id, least(path, min(other)) AS component, path FROM same GROUP BY change_id, path")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(A.net(spark, sf_dir))


#: A file depends on the two before it in its change, on the first one, and on the ninth behind it.
FILE_EDGES_SQL = "fedges AS (SELECT change_id, path AS src, dst FROM (SELECT change_id, path, unnest([lag(path, 1) OVER w, lag(path, 2) OVER w, lead(path, 9) OVER w, first_value(path) OVER w]) AS dst FROM files WINDOW w AS (PARTITION BY change_id ORDER BY file_idx)) WHERE dst IS NOT NULL AND dst <> path)"


def _file_edges(files: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("change_id").orderBy("file_idx")
    targets = files.withColumn("targets", F.array(F.lag("path", 1).over(w), F.lag("path", 2).over(w), F.lead("path", 9).over(w), F.first("path").over(w)))
    rows = targets.select("change_id", F.col("path").alias("src"), F.explode("targets").alias("dst")).filter("dst is not null and dst <> src")
    return rows.withColumn("edge_no", F.lit(0).cast("long"))


STEM_SQL = "regexp_replace(name, '(.)\\.[^.]*$', '\\1')"
FINDINGS_SQL = f"""{NAMED_SQL}, {FILE_EDGES_SQL}, findings AS (
 SELECT f.change_id, f.path, 'Error' AS severity, 'BrokenImport' AS category, e.src AS related_file, CAST(NULL AS BIGINT) AS dependent_count FROM classed f JOIN fedges e ON f.change_id = e.change_id AND f.path = e.dst WHERE f.status = 'Deleted'
 UNION ALL SELECT f.change_id, f.path, 'Warning', 'MissingTest', NULL, NULL FROM classed f WHERE category = 'Source' AND NOT EXISTS (SELECT 1 FROM named p WHERE p.change_id = f.change_id AND p.path <> f.path AND (contains(p.name, concat({STEM_SQL.replace('name', 'f.name')}, '.test.')) OR contains(p.name, concat({STEM_SQL.replace('name', 'f.name')}, '.spec.')) OR contains(p.name, concat({STEM_SQL.replace('name', 'f.name')}, '_test.'))))
 UNION ALL SELECT f.change_id, f.path, 'Info', 'HighImpact', NULL, n FROM classed f JOIN (SELECT change_id, dst, count(*) AS n FROM fedges GROUP BY ALL) e ON f.change_id = e.change_id AND f.path = e.dst WHERE n > 5)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir).withColumn("category", classify.file_category(F.col("path")))
    return ghost.ghost_findings(files, files.select("change_id", "path"), _file_edges(files))


@query(f"WITH {FINDINGS_SQL} SELECT * FROM findings")
def ghost_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).drop("message")


@query(f"WITH {FINDINGS_SQL} SELECT change_id, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos FROM findings GROUP BY change_id")
def ghost_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ghost.finding_counts(_findings(spark, sf_dir))


SIZES_SQL = f"""{NAMED_SQL}, sized AS (SELECT change_id, path, file_idx, length(text) AS size, row_number() OVER (PARTITION BY change_id ORDER BY file_idx) AS rn FROM classed WHERE category NOT IN ('Lock', 'Generated', 'Snapshot')),
 fold AS (SELECT change_id, path, rn, size, 0 AS group_index, size AS cur FROM sized WHERE rn = 1 UNION ALL SELECT s.change_id, s.path, s.rn, s.size, CASE WHEN f.cur + s.size > 20000 THEN f.group_index + 1 ELSE f.group_index END, CASE WHEN f.cur + s.size > 20000 THEN s.size ELSE f.cur + s.size END FROM fold f JOIN sized s ON s.change_id = f.change_id AND s.rn = f.rn + 1),
 members AS (SELECT change_id, path, CAST(group_index AS INT) AS group_index, size FROM fold), {FILE_EDGES_SQL},
 between_ AS (SELECT e.change_id, e.src, e.dst, a.group_index AS g, b.group_index AS h FROM fedges e JOIN members a ON a.change_id = e.change_id AND a.path = e.src JOIN members b ON b.change_id = e.change_id AND b.path = e.dst),
 depends AS (SELECT DISTINCT change_id, g AS group_index, h AS depends_on FROM between_ WHERE h < g)"""


def _split(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    files = A.files(spark, sf_dir).withColumn("category", classify.file_category(F.col("path")))
    sized = files.select("change_id", "path", "category", F.length("text").cast("long").alias("logic_lines"), F.lit(0).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"), "file_idx")
    order = sized.select("change_id", "path", F.col("file_idx").alias("k1"), F.lit("").alias("k2"))
    return split.split_plan(sized.drop("file_idx"), order, _file_edges(files), 20_000)


@query(f"WITH RECURSIVE {SIZES_SQL} SELECT change_id, path, group_index FROM members")
def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)["members"].select("change_id", "path", "group_index")


@query(f"WITH RECURSIVE {SIZES_SQL} SELECT change_id, group_index, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS logic_lines FROM members GROUP BY ALL")
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)["groups"].select("change_id", "group_index", "total_files", "logic_lines")


@query(f"WITH RECURSIVE {SIZES_SQL} SELECT * FROM depends")
def split_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)["depends"]


@query(f"WITH RECURSIVE {SIZES_SQL} SELECT change_id, g AS group_index, src AS file, dst AS missing_dep FROM between_ b WHERE g <> h AND NOT EXISTS (SELECT 1 FROM depends d WHERE d.change_id = b.change_id AND d.group_index = b.g AND d.depends_on = b.h)")
def split_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)["issues"].drop("message")


@query()
def split_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _split(spark, sf_dir)
    return split.branch_plan(plan["groups"], plan["depends"])


RULES = [("**/*.ts", ["types checked", "tests added"]), ("src/**", ["reviewed by core", "tests added"]), ("*.{py,rs}", ["lint clean"]), ("lib/m?/*", ["api stable"]), ("[broken", ["never"])]
ITEMS_SQL = f"""{A.FILES_SQL}, rules(rule_idx, pattern, source_pattern, check_idx, item) AS (VALUES {', '.join(f"({i}, '{checklist.glob_to_regex(w)}', '{w}', {j}, '{c}')" for i, (w, checks) in enumerate(RULES) if checklist.glob_to_regex(w) for j, c in enumerate(checks))}),
 hits AS (SELECT change_id, path, item AS text, source_pattern, row_number() OVER (PARTITION BY change_id, path, item ORDER BY rule_idx, check_idx) AS nth, rule_idx, check_idx FROM (SELECT DISTINCT change_id, path FROM files) f JOIN rules ON regexp_matches(path, pattern)),
 items AS (SELECT change_id, path, CAST(row_number() OVER (PARTITION BY change_id, path ORDER BY rule_idx, check_idx) - 1 AS INT) AS item_idx, text, source_pattern FROM hits WHERE nth = 1)"""


@query(f"WITH {ITEMS_SQL} SELECT *, FALSE AS checked FROM items")
def checklist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.resolve_checklist(A.files(spark, sf_dir), checklist.rule_rows(spark, RULES))


@query(f"WITH {ITEMS_SQL}, saved AS (SELECT path, 'tests added' AS text, file_idx % 2 = 0 AS checked FROM files) SELECT i.*, coalesce(s.checked, FALSE) AS checked FROM items i LEFT JOIN saved s ON i.path = s.path AND i.text = s.text")
def checklist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir)
    saved = files.select(F.lit(0).alias("saved_idx"), "path", F.lit("tests added").alias("text"), (F.col("file_idx") % 2 == 0).alias("checked"))
    return checklist.merge_checklist(checklist.resolve_checklist(files, checklist.rule_rows(spark, RULES)), saved)


@query("SELECT concat('b/', CAST(conv_id AS VARCHAR)) AS branch, CAST(max(turn) AS INT) AS version, md5(arg_max(text, turn)) AS sha, arg_max(role, turn) AS reviewer FROM conversations GROUP BY conv_id")
def latest_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_round(A.rounds(spark, sf_dir)).select("branch", "version", "sha", "reviewer")


@query("SELECT concat('b/', CAST(conv_id AS VARCHAR)) AS branch, CAST(max(turn) + 1 AS INT) AS next_version FROM conversations GROUP BY conv_id")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_version(A.rounds(spark, sf_dir))


@query("SELECT concat(CAST(epoch_us(ts) // 1000 AS VARCHAR), '_', CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 100 END AS VARCHAR), '_', CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS VARCHAR)) AS id, event_id FROM events")
def note_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    where = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 100)
    return A.table(spark, sf_dir, "events").select(classify.note_id(F.col("ts").cast("timestamp"), where, nth).alias("id"), "event_id")


PRS_SQL = "prs AS (SELECT o_orderkey AS number, concat('Order of ', o_orderpriority, ' for customer ', CAST(o_custkey AS VARCHAR)) AS title, CAST(o_custkey AS VARCHAR) AS author, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE 'Merged' END AS state, o_orderdate AS updated_at, o_orderkey % 5 = 0 AS draft, CASE WHEN o_orderkey % 4 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS additions, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS deletions FROM orders)"


@query(f"WITH {PRS_SQL} SELECT number, author, CASE WHEN author = '7' THEN 'mine' ELSE 'review' END AS box FROM prs WHERE state = 'Open'")
def inbox_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.inbox(inbox.list_pull_requests(A.pull_requests(spark, sf_dir), page=None), "7").select("number", "author", "box")


@query(f"""WITH {PRS_SQL}, minutes AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(updated_at)) / 60000000) AS BIGINT) AS m FROM prs), aged AS (SELECT *, CASE WHEN additions IS NOT NULL AND deletions IS NOT NULL THEN concat('+', additions, '/-', deletions) ELSE '' END AS sizes, CASE WHEN m // 60 < 1 THEN concat(m, 'm ago') WHEN m // 60 < 24 THEN concat(m // 60, 'h ago') ELSE concat(m // 1440, 'd ago') END AS age FROM minutes)
 SELECT number, concat('  #', rpad(CAST(number AS VARCHAR), CAST(greatest(5, length(CAST(number AS VARCHAR))) AS INT), ' '), ' ', rpad(CASE WHEN length(title) <= 20 THEN title ELSE concat(left(title, 17), '...') END, 20, ' '), '  [no review] ', lpad(sizes, CAST(greatest(10, length(sizes)) AS INT), ' '), ' ', lpad(age, CAST(greatest(6, length(age)) AS INT), ' '), CASE WHEN draft THEN ' (draft)' ELSE '' END) AS line FROM aged""")
def inbox_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pull_requests(spark, sf_dir).select("number", inbox.line(F.lit(datetime(2000, 1, 1)), 20).alias("line"))


URL_SQL = "CASE c_custkey % 4 WHEN 0 THEN concat('git@github.com:', c_mktsegment, '/', c_name, '.git') WHEN 1 THEN concat('https://github.com/', c_mktsegment, '/', c_name, '/') WHEN 2 THEN concat('https://github.com/', c_mktsegment, '/', c_name, '/x.git') ELSE concat('https://gitlab.com/', c_name) END"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment END AS owner, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN concat(c_name, '/x') END AS repo, CASE WHEN c_custkey % 4 < 3 THEN 'GitHub' ELSE 'GitLab' END AS provider FROM customer")
def remote_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = A.table(spark, sf_dir, "customer").select("c_custkey", F.expr(URL_SQL).alias("url")).withColumn("r", inbox.repository_of(F.col("url")))
    return url.select("c_custkey", "r.owner", "r.repo", inbox.provider_of(F.col("url")).alias("provider"))


@query(f"WITH {A.FILES_SQL} SELECT change_id, count(*) FILTER (file_idx % 2 = 0) AS viewed, count(*) AS total, count(*) FILTER (file_idx % 2 = 0) / count(*) AS share FROM files GROUP BY change_id")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir)
    return state.progress(files, files.filter("file_idx % 2 = 0"))


@query(f"WITH {NAMED_SQL} SELECT path, name AS file, {STEM_SQL} AS stem, ext, regexp_replace(concat('a/../', path, '/./x/..'), '^a/\\.\\./(.*)/\\./x/\\.\\.$', '\\1') AS normal FROM named")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import extension, file_name, normalize_path

    p = F.col("path")
    return A.files(spark, sf_dir).select("path", file_name(p).alias("file"), stem(p).alias("stem"), extension(p).alias("ext"), normalize_path(F.concat(F.lit("a/../"), p, F.lit("/./x/.."))).alias("normal"))


IMPORTS_SQL = f"""{A.FILES_SQL}, first_ AS (SELECT change_id, path, file_idx, first_value(path) OVER (PARTITION BY change_id, file_idx % 6 ORDER BY file_idx) AS target FROM files),
 wanted AS (SELECT change_id, path, target, regexp_replace(regexp_extract(target, '[^/]*$'), '\\.[^.]*$', '') AS base, CASE WHEN ends_with(path, '.ts') OR ends_with(path, '.tsx') THEN 1 WHEN ends_with(path, '.js') THEN 1 WHEN ends_with(path, '.py') THEN 2 WHEN ends_with(path, '.rs') THEN 3 ELSE 0 END AS lang FROM first_)"""


@query(f"WITH {IMPORTS_SQL}, tails(lang, priority, suffix) AS (VALUES (1,0,'.ts'),(1,1,'.tsx'),(1,2,'.js'),(1,3,'.jsx'),(1,4,'/index.ts'),(1,5,'/index.tsx'),(1,6,'/index.js'),(1,7,'/index.jsx'),(1,8,''),(2,0,'.py'),(2,1,'/__init__.py'),(2,2,''),(3,0,'.rs'),(3,1,'/mod.rs'),(3,2,'')), hits AS (SELECT w.change_id, w.path, arg_min(p.path, priority) AS resolved_path FROM wanted w JOIN tails t USING (lang) JOIN files p ON p.change_id = w.change_id AND p.path = concat(regexp_replace(target, '/[^/]*$', ''), '/', base, suffix) GROUP BY ALL) SELECT w.change_id, w.path, h.resolved_path FROM wanted w LEFT JOIN hits h USING (change_id, path)")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file imports the first file of its change with the same rest by 6, from two folders up and down again."""
    from pyspark.sql import Window

    from ..functions.text import directory, file_name

    files = A.files(spark, sf_dir)
    target = F.first("path").over(Window.partitionBy("change_id", F.col("file_idx") % 6).orderBy("file_idx"))
    rows = files.withColumn("target", target).withColumn("language", classify.language(F.col("path")))
    up = F.concat_ws("/", F.transform(F.split(directory(F.col("path")), "/"), lambda _: F.lit("..")))
    source = F.concat(F.lit("./"), up, F.lit("/"), directory(F.col("target")), F.lit("/./"), F.regexp_replace(file_name(F.col("target")), r"\.[^.]*$", ""))
    imports = rows.select("change_id", "path", F.lit(0).alias("import_idx"), "language", source.alias("source"))
    return graph.resolve_imports(imports, files.select("change_id", "path")).select("change_id", "path", "resolved_path")


@query()
def parsed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.parse_functions(A.sources(spark, sf_dir))


@query()
def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.parse_imports(A.sources(spark, sf_dir))


@query()
def parsed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.parse_exports(A.sources(spark, sf_dir))


@query()
def function_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = A.sources(spark, sf_dir)
    # Of the old version some functions had other parameters, some other names.
    old = new.withColumn("content", F.regexp_replace(F.regexp_replace("content", "a, b", "a"), "f_([aeiou])", "g_$1"))
    return semantic.summaries(semantic.function_changes(semantic.parse_functions(old), semantic.parse_functions(new)))


@query()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = A.table(spark, sf_dir, "benchmark").select("item_id", "text")
    other = texts.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before"))
    return moves.similarity(texts.join(other, "item_id"), "text", "before")


@query()
def full_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review of two snapshots, as nested documents in JSON."""
    base, head = _snapshots(spark, sf_dir)
    out = pipeline.review(base, head, A.commits(spark, sf_dir), F.lit(AS_OF))
    spans = out["hunks"].join(out["spans"], ["change_id", "file_idx", "hunk_idx"])
    nested = nested_diff(out["files"], spans, out["lines"], out["summary"], "base", "head")
    return nested.select("change_id", F.to_json(F.struct("base_ref", "head_ref", "files", "summary")).alias("document"))


from . import more_queries  # noqa: E402, F401  (registers its queries)
