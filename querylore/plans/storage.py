"""Sources and sinks: tables written by Spark into the shared scratch folder and read back."""

from pyspark.sql import functions as F

from querylore.functions.text import content_type, object_key
from querylore.operators import catalog as C
from querylore.operators import feedback as V
from querylore.operators import pages as P
from querylore.operators import querylog as Q
from querylore.plans.catalog import BASE, DOC_SQL, JOIN_LISTS, LISTS, _documents
from querylore.plans.query_log import ANALYZED, EXTRACTED, UNIQUE, analyzed, unique
from querylore.plans.query_pages import FILTERS, PAGES, page_queries
from querylore.plans.registry import plan
from querylore.session import scratch_dir
from querylore.sources import query_files as S
from querylore.sources import stores as K
from querylore.sources.folders import dealt_name


@plan("s02_query_json", f"WITH {UNIQUE} SELECT hash AS name, md5(sql) AS query FROM uq WHERE main_table IS NOT NULL")
def _(t):
    # statements without a FROM get no name, so their items lack a key
    items = unique(t).select(F.when(F.col("main_table").isNotNull(), F.col("hash")).alias("name"), F.col("sql").alias("query"))
    path = K.write_json(items, scratch_dir(t.spark, "queries-json"))
    return S.read_query_json(t.spark, path, lines=True).withColumn("query", F.md5("query"))


@plan("s03_query_csv", f"WITH {UNIQUE} SELECT hash AS name, md5(replace(sql, ' FROM ', chr(10) || 'FROM \"quoted\" ')) AS query FROM uq")
def _(t):
    path = scratch_dir(t.spark, "queries-csv")
    broken_lines = F.replace("sql", F.lit(" FROM "), F.lit('\nFROM "quoted" '))
    unique(t).select(F.col("hash").alias("name"), broken_lines.alias("query")).write.csv(path, header=True, quoteAll=True, escape='"')
    return S.read_query_csv(t.spark, path).withColumn("query", F.md5("query"))


def _query_pages(t):
    """Every file of the log under its own name, in one of 256 folders."""
    return K.write_pages(t.query_log.select(dealt_name(F.col("fname")).alias("path"), "content"), scratch_dir(t.spark, "query-files"))


@plan("s04_query_text_files", "SELECT fname AS name, md5(content) AS content FROM query_log")
def _(t):
    return S.read_query_text(t.spark, _query_pages(t)).select("name", F.md5("query").alias("content"))


@plan("s05_query_lines", r"""SELECT md5(line) AS line, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents) WHERE line <> '' GROUP BY 1""")
def _(t):
    path = scratch_dir(t.spark, "lines")
    t.documents.select("text").write.text(path)
    return S.read_query_lines(t.spark, path).groupBy(F.md5("query").alias("line")).agg(F.count("*").alias("n"))


@plan("s06_markdown_folder", f"WITH {EXTRACTED} SELECT query_id, fname, database, hash FROM ex")
def _(t):
    files = S.read_markdown_folder(t.spark, _query_pages(t), "")
    numbered = files.withColumn("query_id", F.regexp_extract("fname", r"_query_(\d+)", 1).cast("bigint"))
    return Q.extract_sql(numbered).select("query_id", "fname", "database", "hash")


@plan("s07_prefixes", "SELECT chunk_id, source FROM kb_chunk WHERE starts_with(source, 's3://kb/src1') OR starts_with(source, 's3://kb/src7/')")
def _(t):
    return t.kb_chunk.filter(S.under_prefixes(F.col("source"), ["s3://kb/src1", "s3://kb/src7/"])).select("chunk_id", "source")


def _stored_documents(t):
    documents = _documents(t)
    path = K.write_json(documents, scratch_dir(t.spark, "schema"))
    return K.read_json(t.spark, path, documents.schema)


@plan("s08_schema_read_back", f"WITH {DOC_SQL[len('WITH '):]} SELECT tenant, table_name, md5(content) AS content FROM docs")
def _(t):
    return C.table_documents(_stored_documents(t)).withColumn("content", F.md5("content"))


@plan("s09_chat_tables_by_sql", "SELECT s.company_id, s.kb_id, count(*) AS messages, count(DISTINCT s.id) AS sessions FROM chat_session s JOIN chat_message m ON s.id = m.session_id GROUP BY 1, 2")
def _(t):
    return t.sql("SELECT s.company_id, s.kb_id, count(*) AS messages, count(DISTINCT s.id) AS sessions FROM chat_session s JOIN chat_message m ON s.id = m.session_id GROUP BY s.company_id, s.kb_id")


@plan("k01_schema_json", rf"""WITH {BASE}, {LISTS}
SELECT b.tenant, b.table_name, replace(b.description, '|', '\|') AS description, coalesce(l_cols.n, 0) AS column_count,
  coalesce(replace(pks.primary_key, ',', ', '), 'None') AS primary_key, coalesce(l_fk.n, 0) AS foreign_key_count FROM base b {JOIN_LISTS}""")
def _(t):
    return C.tables_summary(_stored_documents(t))


@plan("k02_analysis_json", f"WITH {ANALYZED} SELECT query_id, query_type, array_to_string(tables, ',') AS tables, len(joins) AS joins, complexity FROM an")
def _(t):
    results = analyzed(t)
    path = K.write_json(results, K.analysis_path(scratch_dir(t.spark, "analysis") + ".json"))
    stored = K.read_json(t.spark, path, results.schema)
    return stored.select("query_id", "query_type", F.array_join("tables", ",").alias("tables"), F.size("joins").cast("bigint").alias("joins"), "complexity")


@plan("k03_markdown_pages", f"WITH {DOC_SQL[len('WITH '):]} SELECT 'tables/' || tenant || '/' || table_name || '.md' AS path, md5(content) AS content FROM docs")
def _(t):
    path = F.concat(F.lit("tables/"), "tenant", F.lit("/"), "table_name", F.lit(".md"))
    folder = K.write_pages(C.table_documents(_documents(t)).select(path.alias("path"), "content"), scratch_dir(t.spark, "pages"))
    return K.read_pages(t.spark, folder).select("path", F.md5("content").alias("content"))


def _page_plan(name: str, build, sql: str):
    """A page for each tenant, written and read back."""

    @plan(name, sql)
    def _(t):
        folder = K.write_pages(build(t), scratch_dir(t.spark, name))
        return K.read_pages(t.spark, folder).withColumn("content", F.md5("content"))


_NL = "chr(10)"
_page_plan("k03_tables_summary", lambda t: C.tables_summary_pages(_documents(t)), rf"""WITH {BASE}, {LISTS},
sm AS (SELECT b.tenant, b.table_name, replace(b.description, '|', '\|') AS description, coalesce(l_cols.n, 0) AS n,
  coalesce(replace(pks.primary_key, ',', ', '), 'None') AS k, coalesce(l_fk.n, 0) AS f FROM base b {JOIN_LISTS})
SELECT 'tables/' || tenant || '/tables_summary.md' AS path, md5('# Tables Summary' || {_NL} || {_NL} || '| Table Name | Description | # Columns | Primary Key | Foreign Keys |'
  || {_NL} || '|------------|-------------|-----------|-------------|--------------|' || {_NL}
  || string_agg('| [' || table_name || '](./tables/' || table_name || '.md) | ' || description || ' | ' || n || ' | ' || k || ' | ' || f || ' |' || {_NL}, '' ORDER BY table_name)) AS content
FROM sm GROUP BY tenant""")


def _relations(first: str, second: str) -> str:
    def link(x):
        return f"'[' || {x}_table || '](../tables/' || {x}_table || '.md)'"
    line = f"'| ' || {link(first)} || ' | ' || {first}_column || ' | ' || {link(second)} || ' | ' || {second}_column || ' |' || chr(10)"
    return f"string_agg({line}, '' ORDER BY {first}_table, {second}_table, {first}_column, {second}_column)"


_page_plan("k03_relationships_summary", lambda t: C.relationships_summary_pages(C.relationship_edges(t.cat_table, t.cat_key), C.base_tables(t.cat_table)), f"""WITH {BASE},
ed AS (SELECT tenant, table_name AS source_table, column_name AS source_column, ref_table AS target_table, ref_column AS target_column FROM fk),
tx AS (SELECT tenant, {_relations("source", "target")} AS by_source, {_relations("target", "source")} AS by_target FROM ed GROUP BY tenant)
SELECT 'relationships/' || t.tenant || '/relationships_summary.md' AS path, md5('# Database Relationships Summary' || {_NL} || {_NL} || '## Relationships by Source Table' || {_NL} || {_NL}
  || '| Source Table | Source Column | Target Table | Target Column |' || {_NL} || '|--------------|--------------|-------------|---------------|' || {_NL} || coalesce(by_source, '')
  || {_NL} || '## Relationships by Target Table' || {_NL} || {_NL} || '| Target Table | Target Column | Source Table | Source Column |' || {_NL}
  || '|--------------|--------------|-------------|---------------|' || {_NL} || coalesce(by_target, '')) AS content
FROM (SELECT DISTINCT tenant FROM base) t LEFT JOIN tx ON tx.tenant = t.tenant""")

_page_plan("k03_schema_index", lambda t: C.schema_index_pages(C.base_tables(t.cat_table), "2024-01-31"), f"""WITH {BASE}
SELECT 'schema/' || tenant || '/index.md' AS path, md5('# Database Schema Documentation' || {_NL} || {_NL} || 'This documentation describes the database schema extracted on 2024-01-31' || {_NL} || {_NL}
  || '## Contents' || {_NL} || {_NL} || '- [Tables Summary](tables/tables_summary.md)' || {_NL} || '- [Relationships Summary](relationships/relationships_summary.md)' || {_NL}
  || {_NL} || '## Tables' || {_NL} || {_NL} || string_agg('- [' || table_name || '](tables/' || table_name || '.md)' || {_NL}, '' ORDER BY table_name)) AS content FROM base GROUP BY tenant""")


_CATEGORY_SQL = f"""WITH {PAGES}, lv AS (SELECT * FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High'), (3, 'Very High')) AS v(level_no, complexity)),
cl AS (SELECT category, complexity, count(*) AS n FROM pg GROUP BY 1, 2),
lx AS (SELECT t.category, lv.level_no, lv.complexity, coalesce(cl.n, 0) AS n, printf('%.1f%%', coalesce(cl.n, 0)::DOUBLE / total * 100) AS pct
  FROM tot t CROSS JOIN lv LEFT JOIN cl ON cl.category = t.category AND cl.complexity = lv.complexity),
ll AS (SELECT category, string_agg('| ' || complexity || ' | ' || n || ' | ' || pct || ' |' || chr(10), '' ORDER BY level_no) AS levels FROM lx GROUP BY 1),
ct AS (SELECT category, table_name, count(*) AS n FROM pt GROUP BY 1, 2),
tx AS (SELECT ct.category, table_name, n, total, row_number() OVER (PARTITION BY ct.category ORDER BY n DESC, table_name) AS r FROM ct JOIN tot ON ct.category = tot.category),
tt AS (SELECT category, string_agg('| [' || table_name || '](../tables_usage/' || replace(lower(table_name), ' ', '_') || '.md) | ' || n || ' | ' || printf('%.1f%%', n::DOUBLE / total * 100) || ' |' || chr(10), '' ORDER BY r) AS tables FROM tx WHERE r <= 15 GROUP BY 1),
sx AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY complexity, query_id) AS r FROM pg),
ss AS (SELECT category, string_agg('### Query ' || query_id || chr(10) || chr(10) || '**Complexity**: ' || complexity || '  ' || chr(10) || '**Tables**: ' || array_to_string(tables, ', ') || '  '
  || chr(10) || '**Description**: No description available  ' || chr(10) || chr(10) || '```sql' || chr(10) || query_text || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY r) AS samples FROM sx WHERE r <= 20 GROUP BY 1)
SELECT 'query_patterns/' || t.category || '.md' AS path, md5('# ' || t.category || ' Queries' || chr(10) || chr(10) || 'This document contains ' || total
  || ' queries categorized as ' || chr(39) || t.category || chr(39) || '.' || chr(10) || chr(10) || '## Complexity Distribution' || chr(10) || chr(10)
  || '| Complexity | Count | Percentage |' || chr(10) || '|-----------|-------|------------|' || chr(10) || levels
  || coalesce(chr(10) || '## Tables Used in this Category' || chr(10) || chr(10) || '| Table Name | Query Count | Percentage |' || chr(10) || '|------------|------------|------------|' || chr(10) || tables, '')
  || chr(10) || '## Sample Queries' || chr(10) || chr(10) || coalesce(samples, '')) AS content
FROM tot t JOIN ll ON t.category = ll.category LEFT JOIN tt ON t.category = tt.category LEFT JOIN ss ON t.category = ss.category"""


@plan("k03_category_pages", _CATEGORY_SQL)
def _(t):
    folder = K.write_pages(P.category_pages(page_queries(t)), scratch_dir(t.spark, "category-pages"))
    return K.read_pages(t.spark, folder).withColumn("content", F.md5("content"))


_INDEX_SQL = f"""WITH {PAGES}, c AS (SELECT category, count(*) AS n FROM pg GROUP BY 1), u AS (SELECT table_name, count(*) AS n FROM pt GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20)
SELECT 'index.md' AS path, md5('# SQL Query Documentation' || chr(10) || chr(10) || 'This documentation catalogs and analyzes common SQL query patterns from a repository of '
  || (SELECT count(*) FROM pg) || ' queries.' || chr(10) || chr(10) || '## Query Categories' || chr(10) || chr(10)
  || (SELECT string_agg('- [' || category || '](query_patterns/' || replace(lower(category), ' ', '_') || '.md) (' || n || ' queries)' || chr(10), '' ORDER BY n DESC, category) FROM c)
  || chr(10) || '## Most Used Tables' || chr(10) || chr(10) || '| Table Name | Query Count |' || chr(10) || '|------------|------------|' || chr(10)
  || (SELECT string_agg('| [' || table_name || '](tables_usage/' || replace(lower(table_name), ' ', '_') || '.md) | ' || n || ' |' || chr(10), '' ORDER BY n DESC, table_name) FROM u)) AS content"""


@plan("k03_index_page", _INDEX_SQL)
def _(t):
    folder = K.write_pages(P.index_page(page_queries(t)), scratch_dir(t.spark, "index-page"))
    return K.read_pages(t.spark, folder).withColumn("content", F.md5("content"))


def _shares(source: str, link: str, order: str) -> str:
    return f"""SELECT x.table_name, string_agg('| ' || {link} || ' | ' || n || ' | ' || printf('%.1f%%', n::DOUBLE / used.total * 100) || ' |' || chr(10), '' ORDER BY {order}) AS txt
  FROM {source} x JOIN used ON x.table_name = used.table_name GROUP BY 1"""


_USAGE_SQL = f"""WITH {PAGES}, {FILTERS},
k AS (SELECT table_name, min(coalesce(nullif(table_comment, ''), 'Table ' || table_name)) AS description FROM cat_table WHERE table_type = 'BASE TABLE' GROUP BY 1),
uc AS (SELECT table_name, category, count(*) AS n FROM pt GROUP BY 1, 2),
ux AS (SELECT a AS table_name, b AS partner FROM pairs UNION ALL SELECT b, a FROM pairs WHERE a <> b), uj AS (SELECT table_name, partner, count(*) AS n FROM ux GROUP BY 1, 2),
us AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY complexity, query_id) AS r FROM pt),
tc AS ({_shares("uc", "'[' || category || '](../query_patterns/' || replace(lower(category), ' ', '_') || '.md)'", "n DESC, category")}),
tj AS ({_shares("uj", "'[' || partner || '](./' || replace(lower(partner), ' ', '_') || '.md)'", "n DESC, partner")}),
tf AS ({_shares("(SELECT table_name, position, \"column\", n FROM r WHERE position <= 10)", '"column"', "position")}),
ts AS (SELECT table_name, string_agg('### ' || category || ' Query (Complexity: ' || complexity || ')' || chr(10) || chr(10) || '```sql' || chr(10) || query_text || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY r) AS txt
  FROM us WHERE r <= 10 GROUP BY 1)
SELECT 'tables_usage/' || replace(lower(used.table_name), ' ', '_') || '.md' AS path, md5('# ' || used.table_name || ' Usage Documentation' || chr(10) || chr(10)
  || coalesce(description || chr(10) || chr(10) || 'See [full schema documentation](../../schema/tables/' || used.table_name || '.md) for this table.' || chr(10) || chr(10), '')
  || 'This document describes how the `' || used.table_name || '` table is used across ' || used.total || ' queries.' || chr(10) || chr(10) || '## Usage by Category' || chr(10) || chr(10)
  || '| Category | Query Count | Percentage |' || chr(10) || '|----------|------------|------------|' || chr(10) || coalesce(tc.txt, '')
  || coalesce(chr(10) || '## Common Join Patterns' || chr(10) || chr(10) || '| Joined With | Query Count | Percentage |' || chr(10) || '|------------|------------|------------|' || chr(10) || tj.txt, '')
  || coalesce(chr(10) || '## Common WHERE Conditions' || chr(10) || chr(10) || '| Column | Query Count | Percentage |' || chr(10) || '|--------|------------|------------|' || chr(10) || tf.txt, '')
  || chr(10) || '## Sample Queries Using This Table' || chr(10) || chr(10) || coalesce(ts.txt, '')) AS content
FROM used LEFT JOIN k ON used.table_name = k.table_name LEFT JOIN tc ON used.table_name = tc.table_name LEFT JOIN tj ON used.table_name = tj.table_name
LEFT JOIN tf ON used.table_name = tf.table_name LEFT JOIN ts ON used.table_name = ts.table_name"""


@plan("k03_table_usage_pages", _USAGE_SQL)
def _(t):
    folder = K.write_pages(P.table_usage_pages(page_queries(t), C.base_tables(t.cat_table)), scratch_dir(t.spark, "usage-pages"))
    return K.read_pages(t.spark, folder).withColumn("content", F.md5("content"))


_PATH = """'/data/docs/' || source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE chr(92) END || CAST(doc_id AS STRING) ||
  CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' WHEN 3 THEN '.xyz' ELSE '' END"""


@plan("k04_object_keys", f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents)
SELECT doc_id, 'kb/' || replace(substring(path, 12), chr(92), '/') AS key, CASE doc_id % 5 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json' END AS content_type FROM p""")
def _(t):
    files = t.documents.select("doc_id", F.expr(_PATH).alias("path"))
    return files.select("doc_id", object_key(F.col("path"), "/data/docs", "kb").alias("key"), content_type(F.replace("path", F.lit("\\"), F.lit("/"))).alias("content_type"))


@plan("k05_append_and_update", """WITH n AS (SELECT question_id FROM question_log),
u AS (SELECT id, CASE WHEN processing_status = 'pending' AND feedback_type = 'correction' AND corrected_response IS NOT NULL THEN 'reviewed' ELSE processing_status END AS status FROM query_feedback)
SELECT 'feedback ' || status AS kind, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 'messages', (SELECT count(*) FROM chat_message) + (SELECT count(*) FROM n)""")
def _(t):
    columns = ["session_id", "content", "created_at"]
    path = K.append_rows(t.chat_message.select(*columns), scratch_dir(t.spark, "messages"))
    K.append_rows(t.question_log.select("session_id", F.col("query_text").alias("content"), F.col("ts").alias("created_at")), path)
    feedback = t.query_feedback.select("id", "feedback_type", "corrected_response", "processing_status")
    taken = V.training_rows(t.query_feedback).select(F.col("feedback_id").alias("id"))
    changes = feedback.join(taken, "id", "left_semi").withColumn("processing_status", F.lit("reviewed"))
    stored = K.KeyedTable.create(feedback, scratch_dir(t.spark, "feedback"), ["id"])
    stored.update(changes)
    kinds = stored.read().groupBy(F.concat(F.lit("feedback "), "processing_status").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(t.spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit("messages").alias("kind"), "n"))
