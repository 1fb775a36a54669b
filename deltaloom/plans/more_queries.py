"""More registered queries: pull requests, rounds, notes, order of files, moves with edits and function changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import checklist, diff, graph, inbox, moves, queue, semantic, split, state
from ..sources import reports
from . import adapters as A
from .queries import FILE_EDGES_SQL, ITEMS_SQL, NAMED_SQL, PRS_SQL, QUEUE_SQL, RULES, _file_edges, _scored, query

NOW = datetime(2024, 1, 31, 12)


# --- pull requests ---


@query("""SELECT o_orderkey AS number, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, '') AS title, CAST(o_custkey AS VARCHAR) AS author,
 CASE WHEN o_orderstatus = 'P' THEN 'Merged' WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS state, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END, FALSE) AS draft,
 concat('topic/', CAST(o_orderkey AS VARCHAR)) AS head_branch, coalesce(CASE WHEN o_orderkey % 7 > 0 THEN 'main' END, '') AS base_branch, concat('https://example.org/', CAST(o_orderkey AS VARCHAR)) AS url,
 epoch_us(CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE TIMESTAMP '2024-01-31 12:00:00' END) AS created, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS updated,
 CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS additions, o_orderkey AS deletions, 'None' AS review_status, CASE WHEN o_orderkey % 6 > 0 THEN concat(o_orderstatus, ',', o_orderpriority) ELSE '' END AS labels FROM orders""")
def pull_request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS number", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS title", "named_struct('login', CAST(o_custkey AS STRING)) AS user", "CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS merged_at", "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS closed_at",
        "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS draft", "named_struct('ref', concat('topic/', o_orderkey)) AS head", "named_struct('ref', CASE WHEN o_orderkey % 7 > 0 THEN 'main' END) AS base", "concat('https://example.org/', o_orderkey) AS html_url",
        "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS created_at", "o_orderdate AS updated_at", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS additions", "o_orderkey AS deletions", "CASE WHEN o_orderkey % 6 > 0 THEN array(named_struct('name', o_orderstatus), named_struct('name', o_orderpriority)) END AS labels",
    )
    found = inbox.pull_requests(raw, F.lit(NOW))
    return found.select(*(c for c in found.columns if c not in ("created_at", "updated_at", "labels")), F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), F.array_join("labels", ",").alias("labels"))


@query(f"WITH {PRS_SQL}, page AS (SELECT * FROM prs WHERE state = 'Open' ORDER BY number DESC LIMIT 100) SELECT number, author FROM page WHERE CAST(author AS BIGINT) % 1000 < 1000 AND author = (SELECT max(author) FROM page)")
def inbox_of_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of open pull requests, and of it those of the author who comes last."""
    prs = A.pull_requests(spark, sf_dir)
    last = inbox.list_pull_requests(prs).agg(F.max("author")).first()[0]
    return inbox.list_pull_requests(prs, author=last).select("number", "author")


@query(f"WITH {PRS_SQL} SELECT number, title FROM prs WHERE number = (SELECT max(o_orderkey) FROM orders)")
def one_pull_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    prs = A.pull_requests(spark, sf_dir)
    return inbox.pull_request(prs, prs.agg(F.max("number")).first()[0]).select("number", "title")


@query("SELECT c_custkey, concat('https://github.com/', c_mktsegment, '/', c_name, '/pull/', CAST(c_custkey AS VARCHAR)) AS url, replace(concat('topic/', c_mktsegment, '/', c_name), '/', '__') AS file FROM customer")
def pull_request_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = F.concat(F.lit("topic/"), "c_mktsegment", F.lit("/"), "c_name")
    return A.table(spark, sf_dir, "customer").select("c_custkey", inbox.web_url(F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey")).alias("url"), classify.branch_file(branch).alias("file"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS change_id, CASE WHEN c_custkey % 4 = 1 THEN 'main' WHEN c_custkey % 3 = 0 THEN 'master' ELSE 'origin/main' END AS base FROM customer WHERE c_custkey % 4 = 1 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def base_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "filter(array('topic', CASE WHEN c_custkey % 5 = 0 THEN 'origin/main' END, CASE WHEN c_custkey % 3 = 0 THEN 'master' END, CASE WHEN c_custkey % 4 = 1 THEN 'main' END), x -> x IS NOT NULL)"
    return inbox.base_branch(A.table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS change_id", f"explode({names}) AS name"))


# --- rounds, notes, checklists ---

ROUNDS_SQL = "rounds AS (SELECT concat('b/', CAST(conv_id AS VARCHAR)) AS branch, CAST(turn AS INT) AS version, md5(text) AS sha, concat('f', CAST(turn AS VARCHAR), ',g') AS viewed, CAST(length(text) AS BIGINT) AS notes_count FROM conversations), target AS (SELECT max(branch) AS t FROM rounds)"


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "conversations").selectExpr("concat('b/', CAST(conv_id AS STRING)) AS branch", "CAST(turn AS INT) AS version", "md5(text) AS sha", "TIMESTAMP '2024-01-01 00:00:00' AS timestamp", "array(concat('f', turn), 'g') AS files_viewed", "CAST(length(text) AS BIGINT) AS notes_count")


def _shown(rounds: DataFrame) -> DataFrame:
    return rounds.select("branch", "version", "sha", F.array_join("files_viewed", ",").alias("viewed"), "notes_count")


@query(f"WITH {ROUNDS_SQL} SELECT * FROM rounds UNION ALL SELECT t, CAST((SELECT max(version) + 1 FROM rounds WHERE branch = t) AS INT), 'abc', 'x,y', 0 FROM target")
def rounds_started_and_viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round begins on the last branch, two files are viewed in it, one of them twice."""
    rounds = _rounds(spark, sf_dir)
    branch = rounds.agg(F.max("branch")).first()[0]
    return _shown(state.mark_viewed(state.mark_viewed(state.start_round(rounds, branch, "abc", NOW), branch, ["x", "y"]), branch, ["y"]))


@query(f"WITH {ROUNDS_SQL} SELECT branch, version, sha, CASE WHEN closed THEN 'k,l' ELSE viewed END AS viewed, CASE WHEN closed THEN 7 ELSE notes_count END AS notes_count FROM (SELECT *, branch = t AND version = max(version) OVER (PARTITION BY branch) AS closed FROM rounds, target)")
def rounds_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = _rounds(spark, sf_dir)
    return _shown(state.close_session(rounds, rounds.agg(F.max("branch")).first()[0], ["k", "l"], 7))


@query(f"WITH {A.FILES_SQL}, last_ AS (SELECT arg_max(turn, turn) AS turn, conv_id FROM conversations GROUP BY conv_id) SELECT change_id, path FROM files WHERE path IN (SELECT {A.path_of('conv_id')} FROM last_ UNION SELECT {A.path_of('turn')} FROM last_)")
def viewed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = A.table(spark, sf_dir, "conversations").selectExpr("concat('b/', CAST(conv_id AS STRING)) AS branch", "CAST(turn AS INT) AS version", f"array({A.path_of('conv_id')}, {A.path_of('turn')}) AS files_viewed")
    return state.viewed_files(A.files(spark, sf_dir), rounds).select("change_id", "path")


NOTES_SQL = "notes AS (SELECT concat('b', CAST(user_id % 9 AS VARCHAR)) AS branch, concat('n', CAST(event_id AS VARCHAR)) AS id, concat('f', CAST(event_id % 30 AS VARCHAR)) AS file, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 50 AS INT) END AS line, event_type AS content FROM events)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").selectExpr("concat('b', CAST(user_id % 9 AS STRING)) AS branch", "concat('n', CAST(event_id AS STRING)) AS id", "concat('f', CAST(event_id % 30 AS STRING)) AS file", "CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 50 AS INT) END AS line", "event_type AS content", "CAST(ts AS TIMESTAMP) AS created_at")


@query(f"WITH {NOTES_SQL} SELECT * FROM notes WHERE file = 'f3' AND id <> 'n33' UNION ALL SELECT 'b2', concat('1706702400000_5_', CAST(count(*) AS VARCHAR)), 'f3', 5, 'added' FROM notes WHERE branch = 'b2'")
def notes_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note is added, one is deleted, one file's are read."""
    notes = state.add_note(_notes(spark, sf_dir), "b2", "f3", 5, "added", NOW)
    return state.notes_for(state.delete_note(notes, "n33"), "f3").drop("created_at")


@query(f"WITH {NOTES_SQL} SELECT DISTINCT branch, file, line FROM notes WHERE line IS NOT NULL")
def note_line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.note_lines(_notes(spark, sf_dir))


@query(f"WITH {ITEMS_SQL} SELECT *, path = (SELECT min(path) FROM items WHERE text = 'tests added') AND text = 'tests added' AS checked FROM items")
def checklist_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = checklist.resolve_checklist(A.files(spark, sf_dir), checklist.rule_rows(spark, RULES))
    path = items.filter("text = 'tests added'").agg(F.min("path")).first()[0]
    return checklist.toggle_item(items, path, "tests added")


# --- queue, files, order ---


@query(f"WITH {QUEUE_SQL}, placed AS (SELECT change_id, path, row_number() OVER (PARTITION BY change_id ORDER BY priority_score DESC, file_idx) AS position FROM queue) SELECT * FROM placed WHERE change_id = 'c3' AND position BETWEEN 4 AND 8")
def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.page(queue.ranked(_scored(spark, sf_dir).filter("change_id = 'c3'")), 3, 5).select("change_id", "path", "position")


@query(f"WITH {NAMED_SQL} SELECT change_id, path, CAST(CASE WHEN file_idx % 4 > 0 THEN length(text) WHEN file_idx % 8 > 0 THEN file_idx ELSE 0 END AS BIGINT) AS size FROM classed WHERE category = 'Source' AND status <> 'Deleted' AND file_idx % 9 > 0 AND file_idx % 10 > 0")
def eligible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with function changes, and their sizes: logic lines, else additions, else 0."""
    files = A.files(spark, sf_dir).withColumn("category", classify.file_category(F.col("path")))
    files = files.withColumn("old_content", F.when(F.col("file_idx") % 9 > 0, F.col("text"))).withColumn("new_content", F.when(F.col("file_idx") % 10 > 0, F.col("text")))
    logic, additions = F.when(F.col("file_idx") % 4 > 0, F.length("text")), F.when(F.col("file_idx") % 8 > 0, F.col("file_idx"))
    return semantic.eligible(files).select("change_id", "path", split.file_size(logic, additions).cast("long").alias("size"))


@query(f"WITH {A.FILES_SQL}, shots AS (SELECT concat('r', CAST(file_idx % 2 AS VARCHAR)) AS ref, path, text FROM files) SELECT w.ref, w.path, md5(s.text) AS digest FROM (SELECT concat('r', CAST(file_idx % 3 AS VARCHAR)) AS ref, path FROM files) w LEFT JOIN shots s ON s.ref = w.ref AND s.path = w.path")
def contents_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir)
    shots = files.select(F.concat(F.lit("r"), (F.col("file_idx") % 2).cast("string")).alias("ref"), "path", F.col("text").alias("content"))
    return diff.content_at(shots, files.select(F.concat(F.lit("r"), (F.col("file_idx") % 3).cast("string")).alias("ref"), "path")).select("ref", "path", F.md5(F.col("content")).alias("digest"))


@query(f"WITH {A.FILES_SQL}, {FILE_EDGES_SQL}, hub AS (SELECT min(path) AS p FROM files) SELECT 'to' AS way, change_id, dst AS path FROM fedges, hub WHERE src = p UNION ALL SELECT 'from', change_id, src FROM fedges, hub WHERE dst = p")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir)
    edges, hub = _file_edges(files), files.agg(F.min("path")).first()[0]
    to = graph.dependencies(edges, hub).select(F.lit("to").alias("way"), "change_id", "path")
    return to.unionByName(graph.dependents(edges, hub).select(F.lit("from").alias("way"), "change_id", "path"))


WALK_SQL = f"""{A.CHAIN_SQL}, e AS (SELECT DISTINCT change_id, src, dst FROM edges), changed AS (SELECT change_id, path FROM chain WHERE o_orderpriority = '1-URGENT'),
 walk AS (SELECT change_id, path, 0 AS depth FROM changed UNION SELECT e.change_id, e.src, w.depth + 1 FROM walk w JOIN e ON e.change_id = w.change_id AND e.dst = w.path WHERE w.depth < 3),
 found AS (SELECT change_id, path, min(depth) AS depth FROM walk WHERE (change_id, path) NOT IN (SELECT (change_id, path) FROM changed) GROUP BY change_id, path)"""


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = A.chain(spark, sf_dir)
    return graph.impact(edges, nodes.filter("o_orderpriority = '1-URGENT'"), 3)


@query(f"WITH RECURSIVE {WALK_SQL} SELECT change_id, count(*) FILTER (depth = 1) AS direct_count, count(*) FILTER (depth > 1) AS transitive_count, count(*) AS total FROM found GROUP BY change_id")
def impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact_counts(_impact(spark, sf_dir))


@query(f"""WITH RECURSIVE {WALK_SQL}, one AS (SELECT change_id, concat('{{"file":"', path, '","severity":"', CASE WHEN depth = 1 THEN 'direct' ELSE concat('transitive (depth ', CAST(depth AS VARCHAR), ')') END, '"}}') AS item, depth, path FROM found)
 SELECT change_id, concat('{{"file":"x.ts","direct_count":', count(*) FILTER (depth = 1), ',"transitive_count":', count(*) FILTER (depth > 1), ',"total":', count(*), ',"impacted":[', string_agg(item, ',' ORDER BY depth, path), ']}}') AS document FROM one GROUP BY change_id""")
def impact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.impact_documents(_impact(spark, sf_dir).withColumn("severity", graph.severity(F.col("depth"))), "x.ts")


@query(f"""WITH {A.CHAIN_SQL}, placed AS (SELECT change_id, path, rn - 1 AS level FROM chain WHERE ltrim(path, 'o') IS NOT NULL AND CAST(substr(path, 2) AS BIGINT) % 2 = 0),
 every AS (SELECT change_id, path, level FROM placed UNION ALL SELECT change_id, concat('unplaced/', path), NULL FROM placed WHERE CAST(substr(path, 2) AS BIGINT) % 3 = 0)
 SELECT change_id, path, row_number() OVER (PARTITION BY change_id ORDER BY level IS NULL, level, path) AS position FROM every""")
def file_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files in the order of a graph without cycles, of which they are a part; those it does not hold come last."""
    nodes, edges = A.chain(spark, sf_dir)
    order = graph.file_order(graph.topological_levels(nodes, edges), graph.cycles(edges))
    placed = nodes.select("change_id", "path").filter("CAST(substr(path, 2) AS BIGINT) % 2 = 0")
    more = placed.filter("CAST(substr(path, 2) AS BIGINT) % 3 = 0").select("change_id", F.concat(F.lit("unplaced/"), "path").alias("path"))
    return split.ordered_files(placed.unionByName(more), order).select("change_id", "path", "position")


@query(f"""WITH RECURSIVE {A.NET_SQL}, reach AS (SELECT change_id, src, dst FROM net UNION SELECT r.change_id, r.src, n.dst FROM reach r JOIN net n ON n.change_id = r.change_id AND n.src = r.dst), ring AS (SELECT a.change_id, a.src AS path, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.change_id = b.change_id AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.change_id, a.src),
 every AS (SELECT change_id, src AS path FROM net UNION SELECT change_id, dst FROM net)
 SELECT change_id, path, row_number() OVER (PARTITION BY change_id ORDER BY component IS NULL, component, path) AS position FROM every LEFT JOIN ring USING (change_id, path)""")
def cyclic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of files in changes with cycles: cycles first, by their first member, then the rest by path."""
    edges = A.net(spark, sf_dir).withColumn("edge_no", F.lit(0).cast("long"))
    files = edges.select("change_id", F.col("src").alias("path")).unionByName(edges.select("change_id", F.col("dst").alias("path"))).distinct()
    order = graph.file_order(graph.topological_levels(files, edges), graph.cycles(edges))
    return split.ordered_files(files, order).select("change_id", "path", "position")


MEMBERS_SQL = " UNION ALL ".join(f"SELECT 'by{n}' AS change_id, CAST(doc_id % {n} AS INT) AS group_index, doc_id AS position, {A.path_of('doc_id')} AS path FROM documents" for n in (120, 6, 2))


@query(f"""WITH folders AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM ({MEMBERS_SQL})), ends AS (SELECT change_id, group_index, arg_min(folder, position) AS head, min(folder) AS low, max(folder) AS high FROM folders GROUP BY ALL),
 starts AS (SELECT *, left(low, list_max(list_filter(range(0, length(low) + 1), lambda i: left(low, i) = left(high, i)))) AS s FROM ends),
 cut AS (SELECT *, regexp_replace(CASE WHEN s = head OR substr(head, length(s) + 1, 1) = '/' THEN s WHEN contains(s, '/') THEN regexp_replace(s, '/[^/]*$', '') ELSE '' END, '^src/', '') AS name FROM starts)
 SELECT change_id, group_index, CASE WHEN name = '' THEN concat('group-', CAST(group_index AS VARCHAR)) ELSE name END AS name FROM cut""")
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of groups whose files share a folder, the folder above, or none."""
    docs = A.table(spark, sf_dir, "documents")
    members = None
    for n in (120, 6, 2):
        part = docs.selectExpr(f"'by{n}' AS change_id", f"CAST(doc_id % {n} AS INT) AS group_index", "doc_id AS position", f"{A.path_of('doc_id')} AS path")
        members = part if members is None else members.unionByName(part)
    return split.group_names(members)


@query(r"""WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS change_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS group_index, concat('!', c_mktsegment, ' ü/', c_name, '..') AS name, c_custkey % 7 AS total_files FROM customer),
 b AS (SELECT *, concat('split/part-', lpad(CAST(group_index + 1 AS VARCHAR), CAST(greatest(2, length(CAST(group_index + 1 AS VARCHAR))) AS INT), '0'), '-', regexp_replace(regexp_replace(name, '[^\p{L}\p{N}\-_/]', '-', 'g'), '^-+|-+$', '', 'g')) AS branch_name FROM g WHERE group_index < 99)
 SELECT b.change_id, b.group_index, b.branch_name, coalesce(p.branch_name, 'main') AS parent, coalesce(lag(b.branch_name) OVER w, 'main') AS pr_base, concat('[', b.group_index + 1, '/', count(*) OVER (PARTITION BY b.change_id), '] ', b.name) AS pr_title, TRUE AS draft, b.total_files AS file_count
 FROM b LEFT JOIN b p ON p.change_id = b.change_id AND b.group_index > 1 AND p.group_index = b.group_index // 2 WINDOW w AS (PARTITION BY b.change_id ORDER BY b.group_index)""")
def branch_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches and pull requests of groups, each of which depends on those at a third and at half of its index."""
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    name = F.concat(F.lit("!"), "c_mktsegment", F.lit(" ü/"), "c_name", F.lit(".."))
    groups = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("change_id"), nth.cast("int").alias("group_index"), name.alias("name"), (F.col("c_custkey") % 7).alias("total_files")).filter("group_index < 99")
    depends = groups.filter("group_index > 1").select("change_id", "group_index", F.explode(F.array(F.expr("CAST(group_index div 3 AS INT)"), F.expr("CAST(group_index div 2 AS INT)"))).alias("depends_on"))
    return split.branch_plan(groups, depends)


# --- moves and functions ---


@query("""WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') AS l FROM benchmark) SELECT concat('i', CAST(item_id AS VARCHAR)) AS change_id, 0 AS old_file_idx, 0 AS old_hunk_idx, 0 AS old_line_start, len(l) AS old_line_end, 1 AS new_file_idx, 0 AS new_hunk_idx, 0 AS new_line_start, len(l) AS new_line_end, item_id % 2 = 1 AS edited
 FROM w WHERE len(l) > 10 OR (len(l) >= 3 AND item_id % 2 = 0)""")
def all_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each passage as lines move from one file to another, every second time with an edited line."""
    words = F.filter(F.split("text", " "), lambda x: F.trim(x) != "")
    rows = A.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words).alias("line_idx", "line")).withColumn("change_id", F.concat(F.lit("i"), F.col("item_id").cast("string")))
    edited = F.when((F.col("line_idx") == 2) & (F.col("item_id") % 2 == 1), F.concat("line", F.lit("x"))).otherwise(F.col("line"))
    side = lambda i, kind, content: rows.select("change_id", F.lit(i).alias("file_idx"), F.lit(0).alias("hunk_idx"), "line_idx", F.lit(kind).alias("kind"), content.alias("content"))
    return moves.moves(side(0, "Removed", F.col("line")).unionByName(side(1, "Added", edited))).drop("similarity")


FUNCTIONS_SQL = """f AS (SELECT l_returnflag AS change_id, concat('o', CAST(l_orderkey AS VARCHAR)) AS path, concat('f', CAST(l_partkey % 5 AS VARCHAR)) AS name, concat('p', CAST(l_suppkey % 3 AS VARCHAR)) AS params, CASE WHEN l_partkey % 4 > 0 THEN l_linestatus END AS result, CAST(row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) AS INT) AS idx, CAST(l_partkey AS INT) AS line FROM lineitem),
 old AS (SELECT change_id, path, name, params, result, idx, line FROM f WHERE idx % 4 <> 1), now AS (SELECT change_id, path, name, CASE WHEN line % 6 = 0 THEN concat(params, 'q') ELSE params END AS params, CASE WHEN line % 7 = 0 THEN NULL ELSE result END AS result, idx, line FROM f WHERE idx % 5 <> 2),
 last_ AS (SELECT change_id, path, name, arg_max(params, idx) AS params, arg_max(coalesce(result, '-'), idx) AS result FROM old GROUP BY ALL),
 came AS (SELECT n.change_id, n.path, n.name, CASE WHEN l.params IS NULL THEN 'Added' WHEN l.params <> n.params OR l.result <> coalesce(n.result, '-') THEN 'SignatureChanged' ELSE 'BodyChanged' END AS change, n.line, 0 AS side, n.idx FROM now n LEFT JOIN last_ l USING (change_id, path, name)),
 gone AS (SELECT change_id, path, name, 'Deleted' AS change, line, 1 AS side, idx FROM old ANTI JOIN now USING (change_id, path, name)),
 changes AS (SELECT change_id, path, name, change, line, CAST(row_number() OVER (PARTITION BY change_id, path ORDER BY side, idx) - 1 AS INT) AS change_idx FROM (FROM came UNION ALL FROM gone))"""


def _function_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS change_id", "concat('o', CAST(l_orderkey AS STRING)) AS path", "concat('f', CAST(l_partkey % 5 AS STRING)) AS name", "array(concat('p', CAST(l_suppkey % 3 AS STRING))) AS params", "CASE WHEN l_partkey % 4 > 0 THEN l_linestatus END AS return_type", "CAST(row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) AS INT) AS function_idx", "CAST(l_partkey AS INT) AS line")
    new = rows.filter("function_idx % 5 <> 2").withColumn("params", F.expr("CASE WHEN line % 6 = 0 THEN array(concat(params[0], 'q')) ELSE params END")).withColumn("return_type", F.expr("CASE WHEN line % 7 = 0 THEN NULL ELSE return_type END"))
    return semantic.function_changes(rows.filter("function_idx % 4 <> 1"), new)


@query(f"WITH {FUNCTIONS_SQL} SELECT * FROM changes")
def signature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of two versions: added, deleted, of other parameters or results, several of one name."""
    return _function_changes(spark, sf_dir)


@query(f"""WITH {FUNCTIONS_SQL}, n AS (SELECT change_id, path, count(*) FILTER (change = 'Added') AS added, count(*) FILTER (change = 'SignatureChanged') AS changed, count(*) FILTER (change = 'Deleted') AS deleted, count(*) FILTER (change = 'BodyChanged') AS bodies FROM changes GROUP BY ALL)
 SELECT *, nullif(concat_ws(' ', CASE WHEN added > 0 THEN concat('+', added, 'fn') END, CASE WHEN changed > 0 THEN concat('~', changed, 'sig') END, CASE WHEN deleted > 0 THEN concat('-', deleted, 'fn') END), '') AS summary FROM n""")
def function_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.summaries(_function_changes(spark, sf_dir))
