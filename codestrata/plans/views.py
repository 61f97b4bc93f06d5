"""The model's tables as views of a star schema and document tables.

Each is one SELECT that Spark and any engine with the same functions run alike: regions and nations are types, customers, suppliers, orders
and parts methods, foreign keys edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

SYMBOLS = """
SELECT 'R' || CAST(r_regionkey AS STRING) AS id, 'main' AS repo_id, 'F' || CAST(r_regionkey AS STRING) AS file_id, CAST(NULL AS STRING) AS parent_id, 'CLASS' AS kind, 'app' AS package, r_name AS simple_name,
  'app.' || r_name AS fqn, r_name AS signature, CAST(NULL AS STRING) AS return_type, 'public' AS modifiers, CAST(NULL AS STRING) AS framework_role, CAST(1 AS INT) AS start_line, CAST(900 AS INT) AS end_line, CAST(NULL AS STRING) AS param_types FROM region
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'main', 'F' || CAST(n_regionkey AS STRING), 'R' || CAST(n_regionkey AS STRING), CASE WHEN n_nationkey % 5 = 4 THEN 'INTERFACE' ELSE 'CLASS' END, 'app', n_name,
  'app.' || n_name, n_name, NULL, 'public', CASE WHEN n_nationkey % 5 = 0 THEN 'REST_CONTROLLER' WHEN n_nationkey % 5 = 1 THEN 'REPOSITORY' WHEN n_nationkey % 5 = 2 THEN 'SERVICE' END, CAST(n_nationkey AS INT), CAST(n_nationkey + 50 AS INT), NULL FROM nation
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'main', 'F' || CAST(c_nationkey % 5 AS STRING), 'N' || CAST(c_nationkey AS STRING), 'METHOD', 'app', c_name,
  'app#' || c_name, 'void ' || c_name || '()', 'void', CASE WHEN c_acctbal < 0 THEN 'private' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'public' END, CASE WHEN c_custkey % 40 = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'SCHEDULED' WHEN c_custkey % 40 = 2 THEN 'HTTP_ENDPOINT' END, CAST(c_custkey % 997 AS INT), CAST(c_custkey % 997 + 9 AS INT), NULL FROM customer
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'main', 'F' || CAST(s_nationkey % 5 AS STRING), 'N' || CAST(s_nationkey AS STRING), 'METHOD', 'app', s_name,
  'app#' || s_name, 'int ' || s_name || '(String)', 'int', 'public,static', NULL, CAST(s_suppkey % 991 AS INT), CAST(s_suppkey % 991 + 4 AS INT), 'String' FROM supplier
UNION ALL SELECT 'O' || CAST(o_orderkey AS STRING), 'main', 'F' || CAST(o_orderkey % 5 AS STRING), 'N' || CAST(o_custkey % 25 AS STRING), 'METHOD', 'app', 'order' || CAST(o_orderkey AS STRING),
  'app#order' || CAST(o_orderkey AS STRING), 'void order()', 'void', 'public', NULL, CAST(o_orderkey % 983 AS INT), CAST(o_orderkey % 983 + 2 AS INT), NULL FROM orders
UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'main', 'F' || CAST(p_partkey % 5 AS STRING), 'N' || CAST(p_partkey % 25 AS STRING), 'CONSTRUCTOR', 'app', '<init>',
  'app#<init>', p_name, NULL, NULL, NULL, CAST(p_partkey % 977 AS INT), CAST(p_partkey % 977 + 1 AS INT), CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END FROM part
"""

EDGES = """
SELECT 'a' || CAST(n_nationkey AS STRING) AS id, 'main' AS repo_id, 'N' || CAST(n_nationkey AS STRING) AS src_symbol_id, 'R' || CAST(n_regionkey AS STRING) AS dst_symbol_id, 'app.' || r_name AS dst_fqn, CAST(NULL AS STRING) AS dst_member,
  CASE WHEN n_nationkey % 3 = 0 THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS kind, 'F' || CAST(n_regionkey AS STRING) AS file_id, CAST(n_nationkey AS INT) AS line, 'ast' AS resolution, CAST(NULL AS STRING) AS param_types FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'b' || CAST(o_orderkey AS STRING), 'main', 'C' || CAST(o_custkey AS STRING), 'O' || CAST(o_orderkey AS STRING), 'app.orders', 'order' || CAST(o_orderkey AS STRING), 'CALLS', 'F' || CAST(o_custkey % 5 AS STRING), CAST(o_orderkey % 983 AS INT), 'ast', NULL FROM orders
UNION ALL SELECT 'c' || CAST(l_orderkey AS STRING) || '_' || CAST(l_suppkey AS STRING), 'main', 'O' || CAST(l_orderkey AS STRING), 'S' || CAST(l_suppkey AS STRING), 'app.suppliers', 'Supplier' || CAST(l_suppkey AS STRING), 'STATIC_CALL', 'F' || CAST(l_orderkey % 5 AS STRING), CAST(min(l_linenumber) AS INT), 'heuristic', NULL FROM lineitem GROUP BY l_orderkey, l_suppkey
UNION ALL SELECT 'd' || CAST(l_orderkey AS STRING) || '_' || CAST(l_partkey AS STRING), 'main', 'O' || CAST(l_orderkey AS STRING), 'P' || CAST(l_partkey AS STRING), 'app.parts', '<init>', 'NEW', 'F' || CAST(l_orderkey % 5 AS STRING), CAST(min(l_linenumber) AS INT), 'ast', '' FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'e' || CAST(s_suppkey AS STRING), 'main', 'S' || CAST(s_suppkey AS STRING), 'C' || CAST(s_suppkey AS STRING), 'app.customers', c_name, 'CALLS', 'F' || CAST(s_suppkey % 5 AS STRING), CAST(s_suppkey % 991 AS INT), 'ast', NULL FROM supplier JOIN customer ON c_custkey = s_suppkey
UNION ALL SELECT 'f' || CAST(o_orderkey AS STRING), 'main', 'O' || CAST(o_orderkey AS STRING), NULL, 'app.totals', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'FIELD_READ' ELSE 'FIELD_WRITE' END, 'F' || CAST(o_orderkey % 5 AS STRING), CAST(o_orderkey % 983 AS INT), 'unresolved', NULL FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'g' || CAST(o_orderkey AS STRING), 'main', 'O' || CAST(o_orderkey AS STRING), NULL, 'java.io.IOException', NULL, 'THROWS', 'F' || CAST(o_orderkey % 5 AS STRING), CAST(o_orderkey % 983 AS INT), 'unresolved', NULL FROM orders WHERE o_orderstatus = 'F'
"""

#: Edges before linking: targets only by name. A tenth of the names belong to nothing.
UNLINKED = """
SELECT 'b' || CAST(o_orderkey AS STRING) AS id, 'main' AS repo_id, 'O' || CAST(o_orderkey AS STRING) AS src_symbol_id, CAST(NULL AS STRING) AS dst_symbol_id, CASE WHEN o_orderkey % 10 = 0 THEN 'gone.Type' ELSE 'app.' || n_name END AS dst_fqn, c_name AS dst_member,
  'CALLS' AS kind, 'F1' AS file_id, CAST(1 AS INT) AS line, 'heuristic' AS resolution, CAST(NULL AS STRING) AS param_types FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'd' || CAST(p_partkey AS STRING), 'main', 'P' || CAST(p_partkey AS STRING), NULL, 'app.' || n_name, '<init>', 'NEW', 'F1', CAST(2 AS INT), 'heuristic', CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN '' ELSE p_brand END FROM part JOIN nation ON n_nationkey = p_partkey % 25
UNION ALL SELECT 'a' || CAST(s_suppkey AS STRING), 'main', 'S' || CAST(s_suppkey AS STRING), NULL, 'app.' || n_name, NULL, 'EXTENDS', 'F1', CAST(3 AS INT), 'heuristic', NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'z' || CAST(s_suppkey AS STRING), 'main', 'S' || CAST(s_suppkey AS STRING), NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'app.' || n_name END, s_name, 'FIELD_READ', 'F1', CAST(4 AS INT), 'unresolved', NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""

FILES = "SELECT CAST(doc_id AS STRING) AS id, 'main' AS repo_id, source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, n_chars AS mtime, sha1(text) AS sha, n_chars AS size, lang, CAST(0 AS BIGINT) AS indexed_at FROM documents"
DISK = "SELECT source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS mtime, CASE WHEN doc_id % 8 = 0 THEN sha1(text || '!') ELSE sha1(text) END AS sha FROM documents WHERE doc_id % 11 <> 3"
KNOWN = "SELECT source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, n_chars AS mtime, sha1(text) AS sha FROM documents WHERE doc_id % 13 <> 5"

#: A log: errors are exceptions, clicks and views frames, purchases blank lines, signups noise.
TRACE_LINES = """
SELECT CAST(user_id AS STRING) AS path, CAST(event_id AS INT) AS line,
  CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Caused by: ' ELSE '' END || 'app.' || CASE event_id % 5 WHEN 0 THEN 'SQLException' WHEN 1 THEN 'NullPointerException' WHEN 2 THEN 'TimeoutException' WHEN 3 THEN 'CustomError' ELSE 'IllegalStateException' END || ': v' || CAST(event_id AS STRING)
    WHEN 'click' THEN '    at app.U' || CAST(user_id AS STRING) || '.m' || CAST(event_id % 9 AS STRING) || '(F.java:' || CAST(event_id % 500 AS STRING) || ')'
    WHEN 'view' THEN '    at app.V.lambda$run$' || CAST(event_id % 3 AS STRING) || '(Native Method)' WHEN 'purchase' THEN '' ELSE 'noise ' || CAST(event_id AS STRING) END AS text FROM events
"""
HISTORY_SPARK = "SELECT CAST(event_id AS STRING) AS id, 'error|U' || CAST(user_id AS STRING) || '#m' || CAST(event_id % 2 AS STRING) AS signature, 'app.E' || CAST(user_id % 7 AS STRING) AS exception_fqn, 'app.U' || CAST(user_id AS STRING) AS top_class_fqn, 'm' || CAST(event_id % 2 AS STRING) AS top_method, {epoch} AS occurred_at FROM events WHERE event_type = 'error'"
EPOCH = {"spark": "unix_seconds(CAST({c} AS TIMESTAMP))", "duckdb": "CAST(floor(epoch({c})) AS BIGINT)"}


def commits_sql(engine: str) -> str:
    return f"SELECT 'p' || CAST(l_partkey AS STRING) AS path, CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS hash, {EPOCH[engine].format(c='l_shipdate')} AS commit_seconds, l_linenumber AS added, CAST(l_quantity AS BIGINT) AS deleted FROM lineitem"


def history_sql(engine: str) -> str:
    return HISTORY_SPARK.format(epoch=EPOCH[engine].format(c="ts"))


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the views over the tables of a folder; only the tables that it names are opened."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql.replace("\n", " ")}
    for name in used:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} ", f"JOIN {{{name}}} AS {name} ")
    return spark.sql(sql, **used)
