"""Catalog operators and their DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import catalog as C
from querylore.plans.registry import plan

KNOWN = "(SELECT tenant, table_name FROM cat_table WHERE table_type = 'BASE TABLE')"
BASE = f"""
base AS (SELECT tenant, table_name, coalesce(nullif(table_comment, ''), 'Table ' || table_name) AS description FROM cat_table WHERE table_type = 'BASE TABLE'),
cols AS (SELECT c.tenant, c.table_name, c.ordinal, c.column_name,
    CASE WHEN c.char_len <> 0 THEN c.data_type || '(' || c.char_len || ')'
      WHEN c.num_precision <> 0 AND c.num_scale <> 0 THEN c.data_type || '(' || c.num_precision || ',' || c.num_scale || ')'
      WHEN c.num_precision <> 0 THEN c.data_type || '(' || c.num_precision || ')' ELSE c.data_type END AS data_type,
    c.is_nullable = 'YES' AS is_nullable, c.column_default AS "default",
    coalesce(nullif(c.column_comment, ''), 'Column ' || c.column_name || ' in ' || c.table_name) AS description
  FROM cat_column c JOIN base b ON c.tenant = b.tenant AND c.table_name = b.table_name),
pk AS (SELECT k.tenant, k.table_name, k.column_name, k.ordinal FROM cat_key k JOIN base b ON k.tenant = b.tenant AND k.table_name = b.table_name WHERE k.constraint_name = 'PRIMARY'),
pks AS (SELECT tenant, table_name, string_agg(column_name, ',' ORDER BY ordinal) AS primary_key, arg_min(column_name, ordinal) AS first_column FROM pk GROUP BY 1, 2),
fk AS (SELECT k.* FROM cat_key k JOIN base b ON k.tenant = b.tenant AND k.table_name = b.table_name
  JOIN base r ON k.tenant = r.tenant AND k.ref_table = r.table_name),
idx AS (SELECT i.tenant, i.table_name, i.index_name, string_agg(i.column_name, ',' ORDER BY i.seq) AS columns, min(i.non_unique) = 0 AS is_unique,
  i.index_name = 'PRIMARY' AS is_primary FROM cat_index i JOIN base b ON i.tenant = b.tenant AND i.table_name = b.table_name GROUP BY 1, 2, 3),
flagged AS (SELECT c.*,
  EXISTS (SELECT 1 FROM pk p WHERE p.tenant = c.tenant AND p.table_name = c.table_name AND p.column_name = c.column_name) AS is_primary_key,
  EXISTS (SELECT 1 FROM fk f WHERE f.tenant = c.tenant AND f.table_name = c.table_name AND f.column_name = c.column_name) AS is_foreign_key,
  EXISTS (SELECT 1 FROM cat_index i WHERE i.tenant = c.tenant AND i.table_name = c.table_name AND i.column_name = c.column_name) AS has_index FROM cols c)"""


@plan("c01_tables", f"WITH {BASE} SELECT * FROM base")
def _(t):
    return C.base_tables(t.cat_table)


@plan("c02_columns", f"WITH {BASE} SELECT * FROM cols")
def _(t):
    return C.columns(t.cat_table, t.cat_column)


@plan("c03_primary_keys", f"WITH {BASE} SELECT tenant, table_name, primary_key FROM pks")
def _(t):
    return C.primary_keys(t.cat_table, t.cat_key)


@plan("c03_primary_keys_table_order", f"""WITH {BASE}
SELECT p.tenant, p.table_name, string_agg(p.column_name, ',' ORDER BY c.ordinal) AS primary_key FROM pk p
JOIN cols c ON p.tenant = c.tenant AND p.table_name = c.table_name AND p.column_name = c.column_name GROUP BY 1, 2""")
def _(t):
    return C.primary_keys(t.cat_table, t.cat_key, t.cat_column)


@plan("c04_foreign_keys", f"WITH {BASE} SELECT tenant, table_name, column_name, constraint_name, ordinal, ref_table, ref_column FROM fk")
def _(t):
    return C.foreign_keys(t.cat_table, t.cat_key)


@plan("c04_column_references", f"""WITH {BASE} SELECT tenant, table_name, column_name, ref_table, ref_column, constraint_name FROM fk
QUALIFY row_number() OVER (PARTITION BY tenant, table_name, column_name ORDER BY constraint_name DESC) = 1""")
def _(t):
    return C.column_references(C.foreign_keys(t.cat_table, t.cat_key))


@plan("c04_referenced_by", f"WITH {BASE} SELECT tenant, ref_table AS table_name, table_name AS from_table, column_name AS from_column, constraint_name AS via FROM fk")
def _(t):
    return C.referenced_by(C.foreign_keys(t.cat_table, t.cat_key))


@plan("c05_indexes", f"WITH {BASE} SELECT * FROM idx")
def _(t):
    return C.indexes(t.cat_table, t.cat_index)


@plan("c05_column_flags", f"WITH {BASE} SELECT * FROM flagged")
def _(t):
    return C.flagged_columns(t.cat_table, t.cat_column, t.cat_key, t.cat_index)


def _documents(t):
    return C.schema_documents(t.cat_table, t.cat_column, t.cat_key, t.cat_index)


LISTS = """
l_cols AS (SELECT tenant, table_name, count(*) AS n, string_agg(column_name || ' ' || data_type, ';' ORDER BY ordinal) AS txt FROM flagged GROUP BY 1, 2),
l_fk AS (SELECT tenant, table_name, count(*) AS n, string_agg(column_name || '>' || ref_table || '.' || ref_column, ';' ORDER BY constraint_name, ordinal) AS txt FROM fk GROUP BY 1, 2),
l_idx AS (SELECT tenant, table_name, count(*) AS n, string_agg(index_name || '(' || columns || ')', ';' ORDER BY index_name) AS txt FROM idx GROUP BY 1, 2),
l_ref AS (SELECT tenant, ref_table AS table_name, count(*) AS n, string_agg(table_name || '.' || column_name, ';' ORDER BY table_name, constraint_name, column_name) AS txt FROM fk GROUP BY 1, 2)"""
JOIN_LISTS = " ".join(f"LEFT JOIN {x} ON b.tenant = {x}.tenant AND b.table_name = {x}.table_name" for x in ("pks", "l_cols", "l_fk", "l_idx", "l_ref"))


@plan("c06_schema_documents", f"""WITH {BASE}, {LISTS}
SELECT b.*, coalesce(l_cols.txt, '') AS columns, coalesce(pks.primary_key, '') AS primary_key, coalesce(l_fk.txt, '') AS foreign_keys,
  coalesce(l_idx.txt, '') AS indexes, coalesce(l_ref.txt, '') AS referenced_by FROM base b {JOIN_LISTS}""")
def _(t):
    def text(name, line):
        return F.array_join(F.transform(name, line), ";").alias(name)
    return _documents(t).select(
        "tenant", "table_name", "description", text("columns", lambda c: F.concat(c["column_name"], F.lit(" "), c["data_type"])),
        F.array_join("primary_key", ",").alias("primary_key"),
        text("foreign_keys", lambda f: F.concat(f["column_name"], F.lit(">"), f["ref_table"], F.lit("."), f["ref_column"])),
        text("indexes", lambda i: F.concat(i["index_name"], F.lit("("), i["columns"], F.lit(")"))),
        text("referenced_by", lambda r: F.concat(r["from_table"], F.lit("."), r["from_column"])))


@plan("c07_relationship_edges", f"WITH {BASE} SELECT tenant, table_name AS source_table, column_name AS source_column, ref_table AS target_table, ref_column AS target_column FROM fk")
def _(t):
    return C.relationship_edges(t.cat_table, t.cat_key).orderBy("tenant", "source_table", "target_table")


def _ordered(first: str, second: str) -> str:
    return f"""WITH {BASE}, ed AS (SELECT tenant, table_name AS source_table, column_name AS source_column, ref_table AS target_table, ref_column AS target_column FROM fk)
SELECT *, CAST(row_number() OVER (PARTITION BY tenant ORDER BY {first}_table, {second}_table, {first}_column, {second}_column) AS INT) AS position FROM ed"""


@plan("c07_edges_by_source", _ordered("source", "target"))
def _(t):
    return C.ordered_edges(C.relationship_edges(t.cat_table, t.cat_key))


@plan("c07_edges_by_target", _ordered("target", "source"))
def _(t):
    return C.ordered_edges(C.relationship_edges(t.cat_table, t.cat_key), "target")


@plan("c08_tables_summary", rf"""WITH {BASE}, {LISTS}
SELECT b.tenant, b.table_name, replace(b.description, '|', '\|') AS description, coalesce(l_cols.n, 0) AS column_count,
  coalesce(replace(pks.primary_key, ',', ', '), 'None') AS primary_key, coalesce(l_fk.n, 0) AS foreign_key_count FROM base b {JOIN_LISTS}""")
def _(t):
    return C.tables_summary(_documents(t))


def _cells(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |' || chr(10)"


def _tick(flag: str) -> str:
    return f"CASE WHEN {flag} THEN '✓' ELSE '' END"


NL = "chr(10)"
_JOIN_TEXT = f"'SELECT t1.*, t2.*' || {NL} || 'FROM ' || {{0}} || ' t1' || {NL} || 'JOIN ' || {{1}} || ' t2 ON t1.' || {{2}} || ' = t2.' || {{3}}"
_EXAMPLE = f"'### Join with ' || {{0}} || {NL} || {NL} || '[QUERY_EXAMPLE]' || {NL} || '```sql' || {NL} || {{1}} || {NL} || '```' || {NL} || '[/QUERY_EXAMPLE]' || {NL} || {NL}"

def _pipe(column: str) -> str:
    return f"replace({column}, '|', chr(92) || '|')"


_COLUMN_CELLS = _cells(
    "column_name", _pipe("data_type"), "CASE WHEN is_nullable THEN 'YES' ELSE 'NO' END", f"""coalesce({_pipe('"default"')}, 'NULL')""",
    _pipe("description"), _tick("is_primary_key"), _tick("is_foreign_key"), _tick("has_index"))

DOC_SQL = f"""WITH {BASE}, {LISTS},
d_cols AS (SELECT tenant, table_name, string_agg({_COLUMN_CELLS}, '' ORDER BY column_name) AS txt FROM flagged GROUP BY 1, 2),
d_pk AS (SELECT tenant, table_name, string_agg({_cells("column_name")}, '' ORDER BY ordinal) AS txt FROM pk GROUP BY 1, 2),
d_fk AS (SELECT tenant, table_name, string_agg({_cells("column_name", "'[' || ref_table || '](./' || ref_table || '.md)'", "ref_column")}, '' ORDER BY constraint_name, ordinal) AS txt,
  string_agg({_EXAMPLE.format("ref_table", _JOIN_TEXT.format("table_name", "ref_table", "column_name", "ref_column"))}, '' ORDER BY constraint_name, ordinal) AS ex FROM fk GROUP BY 1, 2),
d_ref AS (SELECT f.tenant, f.ref_table AS table_name, string_agg({_cells("'[' || f.table_name || '](./' || f.table_name || '.md)'", "f.column_name", "f.constraint_name")}, '' ORDER BY f.table_name, f.constraint_name, f.column_name) AS txt,
  string_agg({_EXAMPLE.format("f.table_name || ' (referencing)'", _JOIN_TEXT.format("f.ref_table", "f.table_name", "p.first_column", "f.column_name"))}, '' ORDER BY f.table_name, f.constraint_name, f.column_name) AS ex
  FROM fk f LEFT JOIN pks p ON f.tenant = p.tenant AND f.ref_table = p.table_name GROUP BY 1, 2),
d_idx AS (SELECT tenant, table_name, string_agg({_cells("index_name", "replace(columns, ',', ', ')", _tick("is_unique"), _tick("is_primary"))}, '' ORDER BY index_name) AS txt FROM idx GROUP BY 1, 2),
docs AS (SELECT b.tenant, b.table_name, '[TABLE: ' || b.table_name || ']' || {NL} || '# Table: ' || b.table_name || {NL} || {NL} || b.description || {NL} || {NL}
  || '## Quick Statistics' || {NL} || {NL} || '- **Columns**: ' || coalesce(l_cols.n, 0) || {NL} || '- **Primary Key**: ' || coalesce(replace(pks.primary_key, ',', ', '), 'None') || {NL}
  || '- **Foreign Keys**: ' || coalesce(l_fk.n, 0) || {NL} || '- **Referenced By**: ' || coalesce(l_ref.n, 0) || ' tables' || {NL} || '- **Indexes**: ' || coalesce(l_idx.n, 0) || {NL} || {NL}
  || '## Columns' || {NL} || {NL} || '| Column Name | Data Type | Nullable | Default | Description | PK | FK | Indexed |' || {NL}
  || '|-------------|-----------|----------|---------|-------------|----|----|---------|' || {NL} || coalesce(d_cols.txt, '')
  || coalesce({NL} || '## Primary Key' || {NL} || {NL} || '| Column |' || {NL} || '|--------|' || {NL} || d_pk.txt, '')
  || coalesce({NL} || '## Foreign Keys' || {NL} || {NL} || '| Column | Referenced Table | Referenced Column |' || {NL} || '|--------|------------------|-------------------|' || {NL} || d_fk.txt, '')
  || coalesce({NL} || '## Referenced By' || {NL} || {NL} || '| Table | Column | Foreign Key |' || {NL} || '|-------|--------|-------------|' || {NL} || d_ref.txt, '')
  || coalesce({NL} || '## Indexes' || {NL} || {NL} || '| Name | Columns | Unique | Primary |' || {NL} || '|------|---------|--------|--------|' || {NL} || d_idx.txt, '')
  || {NL} || '## Common Join Patterns' || {NL} || {NL} || coalesce(d_fk.ex, '') || coalesce(d_ref.ex, '') || '[/TABLE: ' || b.table_name || ']' || {NL} AS content
  FROM base b {JOIN_LISTS} {" ".join(f"LEFT JOIN {x} ON b.tenant = {x}.tenant AND b.table_name = {x}.table_name" for x in ("d_cols", "d_pk", "d_fk", "d_ref", "d_idx"))})"""


@plan("c09_table_documents", f"{DOC_SQL} SELECT * FROM docs")
def _(t):
    return C.table_documents(_documents(t))


@plan("c10_suggested_joins", f"""WITH {BASE}, joins AS (
SELECT tenant, table_name, ref_table AS other_table, 'references' AS direction, column_name AS own_column, ref_column AS other_column FROM fk
UNION ALL SELECT f.tenant, f.ref_table, f.table_name, 'referenced by', p.first_column, f.column_name FROM fk f JOIN pks p ON f.tenant = p.tenant AND f.ref_table = p.table_name)
SELECT *, {_JOIN_TEXT.format("table_name", "other_table", "own_column", "other_column")} AS join_sql FROM joins""")
def _(t):
    return C.suggested_joins(t.cat_table, t.cat_key)
