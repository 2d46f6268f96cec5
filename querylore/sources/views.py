"""Views that give the supplied star schema the shape the operators expect.

A view is one SQL text for Spark and DuckDB. The only difference is how fixed rows are attached to every row of a
table: ``{rows:name}`` becomes an ``inline`` generator in Spark (no join at all) and a VALUES list in DuckDB.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Fixed rows: name -> (columns with types, values).
FIXED_ROWS: dict[str, tuple[str, list[tuple]]] = {
    "catalog_tables": (
        "table_name STRING, table_comment STRING, table_type STRING",
        [
            ("db_order", "Customer orders", "BASE TABLE"),
            ("db_orderitem", "", "BASE TABLE"),
            ("db_customer", "Customer|master", "BASE TABLE"),
            ("db_product", None, "BASE TABLE"),
            ("order_totals", "derived", "VIEW"),
        ],
    ),
    "catalog_columns": (
        "table_name STRING, ordinal INT, column_name STRING, data_type STRING, char_len INT, num_precision INT, "
        "num_scale INT, is_nullable STRING, column_default STRING, column_comment STRING",
        [
            ("db_order", 1, "wo", "bigint", None, 64, 0, "NO", None, "order number"),
            ("db_order", 2, "customer", "bigint", None, 64, 0, "NO", None, ""),
            ("db_order", 3, "total", "decimal", None, 15, 2, "YES", "0.00", "a|b"),
            ("db_order", 4, "status", "varchar", 1, None, None, "YES", None, None),
            ("db_orderitem", 1, "wo", "bigint", None, 64, 0, "NO", None, None),
            ("db_orderitem", 2, "item", "int", None, 32, 0, "NO", None, None),
            ("db_orderitem", 3, "product", "bigint", None, 64, 0, "NO", None, None),
            ("db_orderitem", 4, "ship_date", "date", None, None, None, "YES", None, None),
            ("db_customer", 1, "customer", "bigint", None, 64, 0, "NO", None, None),
            ("db_customer", 2, "name", "varchar", 25, None, None, "NO", None, "name"),
            ("db_product", 1, "product", "bigint", None, 64, 0, "NO", None, None),
            ("order_totals", 1, "wo", "bigint", None, 64, 0, "NO", None, None),
        ],
    ),
    "catalog_keys": (
        "table_name STRING, ordinal INT, column_name STRING, constraint_name STRING, ref_table STRING, "
        "ref_column STRING",
        [
            ("db_order", 1, "wo", "PRIMARY", None, None),
            ("db_orderitem", 1, "wo", "PRIMARY", None, None),
            ("db_orderitem", 2, "item", "PRIMARY", None, None),
            ("db_customer", 1, "customer", "PRIMARY", None, None),
            ("db_product", 1, "product", "PRIMARY", None, None),
            ("db_order", 1, "customer", "fk_order_customer", "db_customer", "customer"),
            ("db_orderitem", 1, "wo", "fk_item_order", "db_order", "wo"),
            ("db_orderitem", 1, "product", "fk_item_product", "db_product", "product"),
            ("db_orderitem", 1, "product", "fk_item_gone", "dropped_table", "id"),
        ],
    ),
    "catalog_indexes": (
        "table_name STRING, index_name STRING, seq INT, column_name STRING, non_unique INT",
        [
            ("db_order", "PRIMARY", 1, "wo", 0),
            ("db_order", "idx_cust", 1, "customer", 1),
            ("db_orderitem", "PRIMARY", 1, "wo", 0),
            ("db_orderitem", "PRIMARY", 2, "item", 0),
            ("db_customer", "PRIMARY", 1, "customer", 0),
            ("db_customer", "idx_name", 1, "name", 1),
        ],
    ),
    "variant_shifts": (
        "strategy STRING, strategy_no INT, variant_no INT, shift BIGINT",
        [
            ("standard", 0, 0, 0),
            ("expansion", 1, 0, 20),
            ("expansion", 1, 1, 120),
            ("expansion", 1, 2, 220),
            ("expansion", 1, 3, 0),
            ("hyde", 2, 0, 320),
        ],
    ),
}

def _catalog(rows: str, named: tuple[str, ...]) -> str:
    """A catalog per customer. Tenants write their names in three ways, each has comments of its own, and some lack the product table."""

    def column(name: str) -> str:
        if name in named:
            return f"CASE c.c_custkey % 3 WHEN 1 THEN replace(r.{name}, 'db_', 'DB_') WHEN 2 THEN replace(r.{name}, '_', '-') ELSE r.{name} END AS {name}"
        if name == "table_comment":
            return "CASE WHEN r.table_comment <> '' THEN r.table_comment || ' of ' || c.c_name ELSE r.table_comment END AS table_comment"
        return f"r.{name}"

    columns = ", ".join(column(c.split()[0]) for c in FIXED_ROWS[rows][0].split(", "))
    return f"SELECT c.c_name AS tenant, {columns} FROM customer c {{rows:{rows}:r}} WHERE NOT (c.c_custkey % 4 = 0 AND r.table_name = 'db_product')"


VIEWS: dict[str, str] = {
    "query_log": """
SELECT query_id, ts, db, db || '_query_' || lpad(CAST(query_id AS STRING), 9, '0') || '.md' AS fname,
  CASE WHEN base = '' THEN '# Query' || chr(10) || 'no sql here' ELSE
    '# Query' || chr(10) || '## Embedding-Ready Query' || chr(10) || '```sql' || chr(10) ||
    CASE user_id % 3 WHEN 1 THEN lower(base) WHEN 2 THEN replace(base, ' ', '  ') ELSE base END
    || chr(10) || '```' END AS content
FROM (
  SELECT event_id AS query_id, ts, user_id, 'epic' || lpad(CAST(user_id % 7 AS STRING), 8, '0') AS db,
    CASE WHEN event_id % 12 IN (0,1,2,3,4,5,9,10)
         THEN tpl || ' LIMIT ' || CAST(user_id % 4 + 1 AS STRING) ELSE tpl END AS base
  FROM (SELECT event_id, ts, user_id, CASE event_id % 12
    WHEN 0 THEN 'SELECT Customer, Name FROM db_customer WHERE Status = 1 ORDER BY Name'
    WHEN 1 THEN 'SELECT o.Wo, c.Name FROM db_order o JOIN db_customer c ON o.Customer = c.Customer WHERE o.Status >= 1'
    WHEN 2 THEN 'SELECT o.Wo, sh.ShipDate FROM db_order o JOIN db_customer c ON o.Customer = c.Customer LEFT JOIN db_shipping sh ON o.Wo = sh.Wo'
    WHEN 3 THEN 'SELECT Customer, COUNT(*) AS n, SUM(Total) AS t FROM db_order WHERE Status >= 1 GROUP BY Customer HAVING COUNT(*) > 5'
    WHEN 4 THEN 'SELECT c.Name FROM db_customer c WHERE EXISTS (SELECT 1 FROM db_order o WHERE o.Customer = c.Customer)'
    WHEN 5 THEN 'SELECT p.Product, SUM(oi.Qty) AS q FROM db_product p JOIN db_orderitem oi ON p.Product = oi.Product JOIN db_order o ON oi.Wo = o.Wo JOIN db_customer c ON o.Customer = c.Customer LEFT JOIN db_status st ON o.Status = st.Status AND st.Type = 1 WHERE o.Status IN (1, 2) GROUP BY p.Product'
    WHEN 6 THEN 'INSERT INTO db_stock (Product, Qty) VALUES (1, 2)'
    WHEN 7 THEN 'UPDATE db_order SET Status = 2 WHERE Wo = ' || CAST(event_id % 5000 AS STRING)
    WHEN 8 THEN 'DELETE FROM db_stock WHERE Qty = 0'
    WHEN 9 THEN 'SELECT v.Name, SUM(a.Total) AS t FROM db_ap a JOIN db_vendor v ON a.Vendor = v.Vendor GROUP BY v.Name'
    WHEN 10 THEN 'SELECT i.Invoice, i.Total FROM db_invoice i LEFT JOIN db_salesperson s ON i.Salesperson = s.Salesperson WHERE i.Total > 0' || ' /* ' || repeat('note ', 100) || '*/'
    ELSE '' END AS tpl FROM events) a) b
""",
    "question_log": """
SELECT c.conv_id * 20 + c.turn AS question_id, c.conv_id AS session_id, c.conv_id % 5 AS company_id, e.ts,
  CASE (c.conv_id + c.turn) % 5 WHEN 4 THEN
    CASE c.conv_id % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'support' ELSE 'documentation' END
  ELSE 'smart' END AS query_mode,
  CASE (c.conv_id * 3 + c.turn) % 16
    WHEN 0 THEN 'Show me all tables in the database'
    WHEN 1 THEN 'What columns are in the orders table?'
    WHEN 2 THEN 'How do I join customers with orders?'
    WHEN 3 THEN 'SELECT * FROM db_order WHERE DatePaid is not null'
    WHEN 4 THEN 'I''m having an error with my login'
    WHEN 5 THEN 'How do I troubleshoot connection issues?'
    WHEN 6 THEN 'I need help with a ticket'
    WHEN 7 THEN 'What support articles are available for this problem?'
    WHEN 8 THEN 'Where is the tutorial and the manual for this feature?'
    WHEN 9 THEN 'Show me information about orders'
    WHEN 10 THEN 'foreign keys table db_order'
    WHEN 11 THEN 'optimize SELECT a FROM db_order WHERE a = 1'
    WHEN 12 THEN 'Show me all sales orders by payment date'
    WHEN 13 THEN 'error in the query'
    WHEN 14 THEN 'how to guide for the error'
    ELSE 'hello' END AS query_text
FROM conversations c JOIN events e ON e.event_id = c.conv_id * 20 + c.turn
WHERE c.role = 'user'
""",
    "chat_message": """
SELECT c.conv_id * 20 + c.turn AS id, c.conv_id AS session_id, c.conv_id % 20 AS user_id,
  c.conv_id % 5 AS company_id, c.role AS message_type, c.text AS content, e.ts AS created_at,
  CASE c.turn % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'relationship' ELSE 'optimization' END AS query_type,
  CASE c.turn % 3 WHEN 0 THEN '/query' WHEN 1 THEN '/relationship' ELSE '/optimize' END AS endpoint_used,
  CAST(floor(e.value * 10) AS INT) AS response_time_ms,
  CASE WHEN e.event_type = 'error' THEN false ELSE true END AS success,
  CASE c.conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'kb_support' ELSE 'kb_database' END AS source_kb
FROM conversations c JOIN events e ON e.event_id = c.conv_id * 20 + c.turn
""",
    "chat_session": """
SELECT c.conv_id AS id, 'sess-' || lpad(CAST(c.conv_id AS STRING), 8, '0') AS session_uuid,
  c.conv_id % 20 AS user_id, c.conv_id % 5 AS company_id,
  CASE c.conv_id % 2 WHEN 0 THEN 'kb_database' ELSE 'kb_support' END AS kb_id,
  CASE WHEN c.conv_id % 3 = 0 THEN false ELSE true END AS is_active,
  min(e.ts) AS created_at, max(e.ts) AS updated_at
FROM conversations c JOIN events e ON e.event_id = c.conv_id * 20 + c.turn
GROUP BY c.conv_id
""",
    "application": """
SELECT * FROM (VALUES
  (0, 'epic', 'kb_epic_db', 'kb_epic_support', 'kb_epic_docs', true),
  (1, 'dis',  'kb_dis_db',  'kb_dis_support',  CAST(NULL AS STRING), true),
  (2, 'ppd',  'kb_ppd_db',  CAST(NULL AS STRING), 'kb_ppd_docs', true),
  (3, 'lab',  'kb_lab_db',  CAST(NULL AS STRING), CAST(NULL AS STRING), true),
  (4, 'old',  'kb_old_db',  'kb_old_support',  'kb_old_docs', false)
) AS t(company_id, name, database_kb, support_kb, documentation_kb, is_active)
""",
    "query_feedback": """
SELECT l.doc_id AS id, l.doc_id AS message_id, l.doc_id % 20 AS user_id, l.doc_id % 5 AS company_id,
  CASE l.doc_id % 3 WHEN 0 THEN 'correction' WHEN 1 THEN 'rating' ELSE 'improvement_suggestion' END AS feedback_type,
  1 + 2 * l.quality + 2 * (1 - l.toxic) AS rating,
  CASE l.doc_id % 5 WHEN 0 THEN 'Show me all sales orders by payment date' WHEN 1 THEN 'List Customers without orders'
    WHEN 2 THEN 'Which products have late payments' WHEN 3 THEN 'Reorders by customers' ELSE 'Totals' END AS original_query,
  'SELECT * FROM db_salescommissionlog' AS original_response,
  CASE WHEN l.doc_id % 7 = 0 THEN NULL ELSE 'SELECT * FROM db_order WHERE Wo = ' || CAST(l.doc_id AS STRING) END AS corrected_response,
  CASE WHEN l.doc_id % 4 = 0 THEN NULL ELSE 'note ' || CAST(l.doc_id % 11 AS STRING) END AS feedback_notes,
  CASE l.doc_id % 6 WHEN 0 THEN 'wrong_table' WHEN 1 THEN 'syntax_error' WHEN 2 THEN 'missing_where_clause'
    WHEN 3 THEN 'incorrect_joins' WHEN 4 THEN 'wrong_columns' ELSE NULL END AS problem_category,
  CASE l.doc_id % 2 WHEN 0 THEN 'kb_database' ELSE 'kb_support' END AS kb_id,
  CASE (l.doc_id + l.quality) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'applied' ELSE 'rejected' END AS processing_status,
  e.ts AS created_at
FROM labels l JOIN events e ON e.event_id = l.doc_id
""",
    "kb_improvement_log": """
SELECT id, kb_id, company_id, 'content_update' AS improvement_type,
  CASE processing_status WHEN 'applied' THEN 'completed' WHEN 'reviewed' THEN 'in_progress' ELSE 'planned' END AS status,
  CASE WHEN processing_status = 'applied' THEN created_at END AS completed_at, created_at,
  CASE WHEN rating >= 3 THEN '{"rating":' || CAST(rating AS STRING) || '}' END AS success_metrics
FROM query_feedback WHERE feedback_type = 'correction'
""",
    "training_data": """
SELECT id, kb_id, company_id, lower(original_query) AS query_pattern, id % 9 AS times_used,
  CASE WHEN id % 9 > 0 THEN created_at END AS last_used_at
FROM query_feedback WHERE feedback_type = 'correction' AND corrected_response IS NOT NULL
""",
    # users who ask and the companies and users already on file
    "user_context": """
SELECT event_id, ts, 'u' || CAST(user_id AS STRING) AS login_id, 'C' || CAST(user_id AS STRING) AS company_code, user_id % 5 AS application_id FROM events
""",
    "company": "SELECT c_custkey AS id, 'C' || CAST(c_custkey AS STRING) AS company_code FROM customer WHERE c_acctbal >= 0",
    "app_user": """
SELECT c_custkey AS id, 'u' || CAST(c_custkey AS STRING) AS login_id, c_custkey AS company_id FROM customer WHERE c_acctbal >= 5000
""",
    # one chunk per document; vectors are dealt round and round, so every document and every vector takes part
    "kb_chunk": """
SELECT d.chunk_id, d.source, d.content, e.embedding, e.label,
  CASE e.label % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'support' ELSE 'documentation' END AS kb_type
FROM (SELECT doc_id AS chunk_id, 's3://kb/' || source || '/' || CAST(doc_id AS STRING) || '.md' AS source,
        text AS content, doc_id % (SELECT count(*) FROM embeddings) AS vec_id FROM documents) d
JOIN embeddings e ON e.vec_id = d.vec_id
""",
    # every vector is a question; a variant whose vector would lie past the last one is missing
    "query_variant": """
SELECT v.query_id, v.strategy, v.strategy_no, v.variant_no, e.embedding, v.label,
  CASE v.label % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'support' ELSE 'documentation' END AS kb_type
FROM (SELECT q.vec_id AS query_id, q.label, s.strategy, s.strategy_no, s.variant_no, q.vec_id + s.shift AS vec_id
      FROM embeddings q {rows:variant_shifts:s}) v
JOIN embeddings e ON e.vec_id = v.vec_id
""",
    # the distinct questions of the log, each with a vector
    "text_question": """
SELECT q.query_id, q.query_text, e.embedding
FROM (SELECT min(question_id) AS query_id, query_text,
        min(question_id) % (SELECT count(*) FROM embeddings) AS vec_id FROM question_log GROUP BY query_text) q
JOIN embeddings e ON e.vec_id = q.vec_id
""",
    # one catalog per customer: the catalog grows with the customer table
    "cat_table": _catalog("catalog_tables", ("table_name",)),
    "cat_column": _catalog("catalog_columns", ("table_name",)),
    "cat_key": _catalog("catalog_keys", ("table_name", "ref_table")),
    "cat_index": _catalog("catalog_indexes", ("table_name",)),
    "db_order": """
SELECT o_orderkey AS wo, o_custkey AS customer, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS status,
  o_custkey % 10 AS salesperson, o_orderpriority AS priority
FROM orders
""",
    "db_orderitem": """
SELECT l_orderkey AS wo, l_linenumber AS item, l_partkey AS product, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal, l_suppkey AS stock, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem
""",
    "db_customer": """
SELECT c.c_custkey AS customer, c.c_name AS name, c.c_mktsegment AS type, n.n_name AS city, r.r_name AS state,
  CASE WHEN c.c_acctbal >= 0 THEN 'Active' ELSE 'Closed' END AS status
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "db_product": """
SELECT p_partkey AS product, p_name AS description, p_type AS category, p_brand AS brand, p_size AS capacity_group,
  p_size * 2 AS reorder_point, p_size * 4 AS reorder_qty, CAST(p_retailprice AS DECIMAL(18,2)) AS standard_cost,
  CASE WHEN p_size % 9 = 0 THEN 'Retired' ELSE 'Active' END AS status
FROM part
""",
    "db_stock": """
SELECT l_partkey AS product, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS qty,
  CASE WHEN l_linestatus = 'O' THEN 'Available' ELSE 'Hold' END AS status, l_suppkey % 5 AS warehouse
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey, l_linestatus, l_suppkey % 5
""",
    "db_shipping": """
SELECT l_orderkey AS wo, 'TRK' || lpad(CAST(l_orderkey AS STRING), 9, '0') AS tracking, CAST(min(l_shipdate) AS DATE) AS ship_date
FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'N' GROUP BY l_orderkey
""",
    "db_status": """
SELECT * FROM (VALUES (0, 'ORDER', 'Finished'), (1, 'ORDER', 'Open'), (2, 'ORDER', 'Processing'), (1, 'STOCK', 'Available'))
AS t(status, type, description)
""",
    "db_salesperson": """
SELECT s_suppkey AS salesperson, 'First' || CAST(s_suppkey AS STRING) AS first_name, s_name AS name
FROM supplier WHERE s_acctbal >= 0
""",
}


def _literal(value, sql_type: str) -> str:
    if value is None:
        return f"CAST(NULL AS {sql_type})"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS {sql_type})"


def _rows(name: str, alias: str, engine: str) -> str:
    columns, values = FIXED_ROWS[name]
    names, types = zip(*(c.split() for c in columns.split(", ")))
    rows = [", ".join(_literal(v, t) for v, t in zip(row, types)) for row in values]
    if engine == "spark":
        return f"LATERAL VIEW inline(array({', '.join(f'struct({r})' for r in rows)})) {alias} AS {', '.join(names)}"
    return f"CROSS JOIN (VALUES {', '.join(f'({r})' for r in rows)}) AS {alias}({', '.join(names)})"


def _render(text: str, engine: str) -> str:
    return re.sub(r"\{rows:(\w+):(\w+)\}", lambda m: _rows(m.group(1), m.group(2), engine), text)


def spark_text(name: str) -> str:
    return _render(VIEWS[name], "spark")


def duckdb_text(name: str) -> str:
    return _render(VIEWS[name], "duckdb")


def needed_views(text: str) -> list[str]:
    """Tables and views a text reads."""
    words = set(re.findall(r"(?i)\b(?:FROM|JOIN)\s+(\w+)", text))
    return [n for n in (*BASE_TABLES, *VIEWS) if n in words]


def with_views(sql: str) -> str:
    """Put the views a DuckDB text reads in front of it as common table expressions."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in needed_views(text):
            if name in VIEWS and name not in wanted:
                add(VIEWS[name])
                wanted.append(name)

    add(sql)
    body = sql.strip()
    ctes = ", ".join(f"{name} AS ({duckdb_text(name).strip()})" for name in wanted)
    if not ctes:
        return body
    if re.match(r"(?i)WITH\b", body):
        return f"WITH {ctes}, {re.sub(r'(?i)^WITH', '', body).lstrip()}"
    return f"WITH {ctes} {body}"
