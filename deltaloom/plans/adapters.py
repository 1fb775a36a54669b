"""The driver's tables as tables of code review: the same rules in Spark and in DuckDB, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import line_rows


def path_of(n: str) -> str:
    """A path from a number, such that all categories and languages occur."""
    return (
        f"concat(CASE {n} % 6 WHEN 0 THEN 'src/core/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'src/ui/' WHEN 3 THEN 'app/test/' WHEN 4 THEN 'pkg/types/' ELSE 'pkg/generated/' END, "
        f"'m', CAST({n} % 40 AS VARCHAR(20)), '/f', CAST({n} AS VARCHAR(20)), "
        f"CASE {n} % 13 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' WHEN 3 THEN '.test.ts' WHEN 4 THEN '.d.ts' WHEN 5 THEN '.config.js' WHEN 6 THEN '.css' WHEN 7 THEN '.md' WHEN 8 THEN '.snap' WHEN 9 THEN '.tsx' WHEN 10 THEN '.js' WHEN 11 THEN '.rs' ELSE '.py' END)"
    )


STATUS = "CASE doc_id % 7 WHEN 0 THEN 'Added' WHEN 1 THEN 'Deleted' ELSE 'Modified' END"
KIND = f"CASE WHEN {STATUS} = 'Added' THEN 'Added' WHEN {STATUS} = 'Deleted' THEN 'Removed' WHEN line_idx % 5 < 2 THEN 'Context' WHEN line_idx % 2 = 0 THEN 'Added' ELSE 'Removed' END"
CHANGE = "concat('c', CAST(doc_id % 16 AS VARCHAR(20)))"
#: What the second of two snapshots or rounds has changed.
EDIT = "CASE WHEN doc_id % 3 = 0 THEN concat(text, ' edited') ELSE text END"

#: DuckDB's views of the same tables.
FILES_SQL = f"files AS (SELECT {CHANGE} AS change_id, CAST(doc_id AS INT) AS file_idx, {path_of('doc_id')} AS path, {STATUS} AS status, text FROM documents)"
LINES_SQL = f"""rows_ AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS line_idx FROM (SELECT doc_id, regexp_replace(text, '\\n$', '') AS t FROM documents WHERE text <> '')),
 lines AS (SELECT {CHANGE} AS change_id, CAST(doc_id AS INT) AS file_idx, CAST(line_idx // 20 AS INT) AS hunk_idx, CAST(line_idx AS INT) AS line_idx, {KIND} AS kind, line AS content FROM rows_)"""
COMMITS_SQL = f"commits AS (SELECT {path_of('(event_id % 1000)')} AS path, ts, CAST(user_id AS VARCHAR) AS author FROM events)"
#: An order depends on the customer's order before and on the one before the last two.
CHAIN_SQL = """chain AS (SELECT concat('c', CAST(o_custkey % 8 AS VARCHAR(20))) AS change_id, concat('o', CAST(o_orderkey AS VARCHAR(20))) AS path,
   lag(o_orderkey, 1) OVER w AS one, lag(o_orderkey, 3) OVER w AS three, row_number() OVER w AS rn, o_orderpriority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 edges AS (SELECT change_id, path AS src, concat('o', CAST(one AS VARCHAR(20))) AS dst, 1 AS edge_no FROM chain WHERE one IS NOT NULL UNION ALL SELECT change_id, path, concat('o', CAST(three AS VARCHAR(20))), 2 FROM chain WHERE three IS NOT NULL)"""
#: Suppliers whose lines follow each other in an order.
NET_SQL = """net AS (SELECT DISTINCT change_id, src, dst FROM (SELECT concat(l_returnflag, l_linestatus) AS change_id, concat('s', CAST(l_suppkey AS VARCHAR(20))) AS src,
   concat('s', CAST(lead(l_suppkey) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS VARCHAR(20))) AS dst FROM lineitem) WHERE dst <> 's' AND dst IS NOT NULL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{CHANGE} AS change_id", "CAST(doc_id AS INT) AS file_idx", f"{path_of('doc_id')} AS path", f"{STATUS} AS status", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(table(spark, sf_dir, "documents"), "doc_id", text="text")
    return rows.selectExpr(f"{CHANGE} AS change_id", "CAST(doc_id AS INT) AS file_idx", "CAST(line_idx DIV 20 AS INT) AS hunk_idx", "line_idx", f"{KIND} AS kind", "line AS content")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(f"{path_of('(event_id % 1000)')} AS path", "CAST(ts AS TIMESTAMP) AS ts", "CAST(user_id AS STRING) AS author")


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (change_id, path, o_orderpriority) and edges of the orders' graph."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("deltaloom_orders")
    nodes = spark.sql("""SELECT concat('c', CAST(o_custkey % 8 AS STRING)) AS change_id, concat('o', CAST(o_orderkey AS STRING)) AS path, lag(o_orderkey, 1) OVER w AS one, lag(o_orderkey, 3) OVER w AS three, o_orderpriority
        FROM deltaloom_orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
    edge = lambda c, n: nodes.filter(F.col(c).isNotNull()).select("change_id", F.col("path").alias("src"), F.concat(F.lit("o"), F.col(c).cast("string")).alias("dst"), F.lit(n).cast("long").alias("edge_no"))
    return nodes.select("change_id", "path", "o_orderpriority"), edge("one", 1).unionByName(edge("three", 2))


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("deltaloom_lineitem")
    return spark.sql(f"WITH {NET_SQL.replace('lineitem', 'deltaloom_lineitem').replace('VARCHAR(20)', 'STRING')} SELECT change_id, src, dst FROM net")


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS number", "concat('Order of ', o_orderpriority, ' for customer ', CAST(o_custkey AS STRING)) AS title", "CAST(o_custkey AS STRING) AS author", "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE 'Merged' END AS state",
        "o_orderkey % 5 = 0 AS draft", "CAST(o_orderdate AS TIMESTAMP) AS updated_at", "CAST(CASE WHEN o_orderkey % 4 > 0 THEN floor(o_totalprice) END AS BIGINT) AS additions", "CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS BIGINT) AS deletions", "'None' AS review_status",
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("concat('b/', CAST(conv_id AS STRING)) AS branch", "CAST(turn AS INT) AS version", "md5(text) AS sha", "role AS reviewer", "length(text) AS notes_count")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of code made of whole documents: definitions named by the words that begin their lines, with the line itself as
    a comment."""
    rows = files(spark, sf_dir)
    named = F.transform(F.split("text", "\n"), lambda x: F.struct(F.regexp_replace(F.substring_index(x, " ", 1), r"\W", "").alias("w"), F.regexp_replace(x, r"[\r\u2028\u2029]", " ").alias("line")))
    made = lambda mark, code: F.array_join(F.transform(named, lambda x: F.concat(F.lit(mark), x["line"], F.when(x["w"] == "", "").otherwise(code(x["w"])))), "\n")
    python = made("# ", lambda w: F.concat(F.lit("\ndef f_"), w, F.lit("(a, b: int) -> "), w, F.lit(":\n    import "), w))
    rust = made("// ", lambda w: F.concat(F.lit("\npub fn f_"), w, F.lit("(&self, a: Vec<u8, u8>) -> "), w, F.lit(" {\nuse crate::"), w, F.lit("::{A, B};")))
    script = made("// ", lambda w: F.concat(F.lit("\nexport function f_"), w, F.lit('(a, b = 1): '), w, F.lit(' {}\nimport { a as '), w, F.lit(' } from "./'), w, F.lit('";')))
    return rows.select("change_id", "path", "status", F.when(F.col("path").endswith(".py"), python).when(F.col("path").endswith(".rs"), rust).otherwise(script).alias("content"))
