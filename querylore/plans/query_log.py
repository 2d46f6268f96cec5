"""Query log operators and their DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import querylog as Q
from querylore.plans.registry import plan

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
HASH = r"md5(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
EXTRACTED = rf"""
ex0 AS (SELECT query_id, fname, coalesce(nullif(regexp_extract(fname, '^(epic\w+)_query_', 1), ''), 'unknown') AS database,
  nullif({TRIM.format("regexp_extract(content, '## Embedding-Ready Query\\s*```sql\\s*(.*?)```', 1, 's')".replace(chr(92) * 2, chr(92)))}, '') AS sql FROM query_log),
ex AS (SELECT *, {HASH.format("sql")} AS hash, nullif(regexp_extract(sql, '(?i)FROM\s+(\w+)', 1), '') AS main_table FROM ex0)"""
DISTINCT = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"
UNIQUE = rf"""{EXTRACTED},
uq0 AS (SELECT hash, min(query_id) AS query_id, arg_min(sql, query_id) AS sql, list_sort(list(DISTINCT database)) AS databases, count(*) AS files
  FROM ex WHERE hash IS NOT NULL GROUP BY hash),
uq1 AS (SELECT *, nullif(regexp_extract(sql, '(?i)FROM\s+(\w+)', 1), '') AS main_table FROM uq0),
uq2 AS (SELECT *, list_concat(CASE WHEN main_table IS NULL THEN [] ELSE [main_table] END, regexp_extract_all(sql, '(?i)JOIN\s+(\w+)', 1)) AS t FROM uq1),
uq AS (SELECT *, {DISTINCT.format("t")} AS tables FROM uq2)"""
COND = r"(?i)\b(?:WHERE|AND|OR|ON)\s+((?:\w+\.)?\w+\s*(?:>=|<=|<>|!=|=|>|<|\bIN\b|\bLIKE\b|\bBETWEEN\b|\bIS\b))"
ANALYZED = rf"""{UNIQUE},
an0 AS (SELECT query_id, sql, main_table, databases, regexp_replace(regexp_replace(regexp_replace(sql, '/\*.*?\*/', ' ', 'gs'), '--[^\n]*', ' ', 'g'), '''[^'']*''', '''''', 'g') AS clean FROM uq),
an1 AS (SELECT *, upper(regexp_extract(clean, '^\s*(\w+)', 1)) AS verb, regexp_extract_all(clean, '(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+(\w+)', 1) AS t0,
  list_transform(regexp_extract_all(clean, '(?i)\b((?:(?:LEFT|RIGHT|FULL|INNER|CROSS)\s+(?:OUTER\s+)?)?JOIN\s+\w+)', 1),
    lambda j: upper(regexp_extract(j, '(?i)^(LEFT|RIGHT|FULL|INNER|CROSS)', 1)) || ' ' || regexp_extract(j, '(\w+)$', 1)) AS j0,
  regexp_extract_all(clean, '\w+\.(\w+)', 1) AS c0,
  list_transform(regexp_extract_all(clean, '{COND}', 1), lambda c: regexp_extract(c, '^(?:\w+\.)?(\w+)', 1) || ' ' || upper(regexp_extract(c, '(?i)(>=|<=|<>|!=|=|>|<|IN|LIKE|BETWEEN|IS)$', 1))) AS w0 FROM an0),
an2 AS (SELECT query_id, sql, main_table, databases, clean, CASE WHEN verb IN ('SELECT','INSERT','UPDATE','DELETE','REPLACE','MERGE','CREATE','ALTER','DROP') THEN verb ELSE 'UNKNOWN' END AS query_type,
  {DISTINCT.format("t0")} AS tables, {DISTINCT.format("j0")} AS joins, {DISTINCT.format("c0")} AS columns, {DISTINCT.format("w0")} AS conditions FROM an1),
an3 AS (SELECT *, CASE WHEN query_type = 'SELECT' THEN 1.0::DOUBLE WHEN query_type IN ('INSERT','UPDATE','DELETE') THEN 2.0::DOUBLE ELSE 0 END + len(tables) * 0.5::DOUBLE
  + len(joins) * 1.5::DOUBLE + len(conditions) * 0.5::DOUBLE + CASE WHEN length(sql) > 1000 THEN 2.0::DOUBLE WHEN length(sql) > 500 THEN 1.0::DOUBLE ELSE 0 END AS score FROM an2),
an AS (SELECT *, CASE WHEN score > 8 THEN 'High' WHEN score > 4 THEN 'Medium' ELSE 'Low' END AS complexity FROM an3)"""
_AREAS = ", ".join(f"CASE WHEN list_has_any(tables, {names}) THEN '{area}' END" for area, names in Q.AREA_TABLES.items())
AREAS = rf"""{ANALYZED},
ar0 AS (SELECT *, regexp_matches(upper(sql), '\b(SUM|COUNT|AVG|MIN|MAX)\s*\(') AS agg FROM an),
ar1 AS (SELECT *, list_sort(list_filter([{_AREAS}, CASE WHEN agg AND contains(upper(sql), 'GROUP BY') THEN 'reporting' END,
  CASE WHEN query_type = 'SELECT' AND len(tables) = 1 AND len(joins) = 0 AND NOT agg THEN 'simple_lookup' END], lambda x: x IS NOT NULL)) AS cats FROM ar0),
ar AS (SELECT *, CASE WHEN len(cats) = 0 THEN ['general'] ELSE cats END AS categories FROM ar1)"""


def extracted(t):
    return Q.extract_sql(t.query_log)


def unique(t):
    return Q.dedup_queries(extracted(t))


def analyzed(t):
    return Q.analyze_queries(unique(t))


def with_areas(t):
    return Q.business_areas(analyzed(t))


@plan("q01_embedded_query", f"WITH {EXTRACTED} SELECT query_id, sql FROM ex")
def _(t):
    return extracted(t).select("query_id", "sql")


@plan("q02_database_of_file", f"WITH {EXTRACTED} SELECT query_id, fname, database FROM ex")
def _(t):
    return extracted(t).select("query_id", "fname", "database")


@plan("q03_query_hash", f"WITH {EXTRACTED} SELECT query_id, hash FROM ex")
def _(t):
    return extracted(t).select("query_id", "hash")


@plan("q04_main_table", f"WITH {EXTRACTED} SELECT query_id, main_table FROM ex")
def _(t):
    return extracted(t).select("query_id", "main_table")


@plan("q05_all_tables", f"WITH {UNIQUE} SELECT hash, array_to_string(tables, ',') AS tables FROM uq")
def _(t):
    return unique(t).select("hash", F.array_join("tables", ",").alias("tables"))


@plan("q06_dedup", f"WITH {UNIQUE} SELECT hash, query_id, sql, array_to_string(databases, ',') AS databases, files, main_table FROM uq")
def _(t):
    return unique(t).select("hash", "query_id", "sql", F.array_join("databases", ",").alias("databases"), "files", "main_table")


@plan("q07_corpus_counts", f"""WITH {EXTRACTED} SELECT count(*) AS total_files, count(*) AS processed_files, count(hash) AS files_with_queries,
  count(DISTINCT hash) AS unique_queries, count(hash) - count(DISTINCT hash) AS duplicates_removed FROM ex""")
def _(t):
    return Q.corpus_counts(extracted(t))


@plan("q08_queries_per_table", f"WITH {UNIQUE} SELECT main_table, count(*) AS n FROM uq WHERE main_table IS NOT NULL GROUP BY 1")
def _(t):
    return Q.queries_per_table(unique(t))


@plan("q08_queries_per_database", f"WITH {UNIQUE} SELECT d AS database, count(*) AS n FROM (SELECT unnest(databases) AS d FROM uq) GROUP BY 1")
def _(t):
    return Q.queries_per_database(unique(t))


@plan("q09_shared_queries", f"WITH {UNIQUE} SELECT left(hash, 8) AS hash, array_to_string(databases, ', ') AS databases FROM uq WHERE len(databases) > 1 ORDER BY query_id LIMIT 5")
def _(t):
    return Q.shared_queries(unique(t))


@plan("q10_statement_type", f"WITH {ANALYZED} SELECT query_id, query_type FROM an")
def _(t):
    return analyzed(t).select("query_id", "query_type")


@plan("q11_statement_tables", f"WITH {ANALYZED} SELECT query_id, array_to_string(tables, ',') AS tables FROM an")
def _(t):
    return analyzed(t).select("query_id", F.array_join("tables", ",").alias("tables"))


@plan("q12_joins", f"WITH {ANALYZED} SELECT query_id, array_to_string(joins, ',') AS joins FROM an")
def _(t):
    entries = F.transform("joins", lambda j: F.concat(j["kind"], F.lit(" "), j["table"]))
    return analyzed(t).select("query_id", F.array_join(entries, ",").alias("joins"))


@plan("q13_columns", f"WITH {ANALYZED} SELECT query_id, array_to_string(columns, ',') AS columns FROM an")
def _(t):
    return analyzed(t).select("query_id", F.array_join("columns", ",").alias("columns"))


@plan("q14_conditions", f"WITH {ANALYZED} SELECT query_id, array_to_string(conditions, ',') AS conditions FROM an")
def _(t):
    entries = F.transform("conditions", lambda c: F.concat(c["column"], F.lit(" "), c["operator"]))
    return analyzed(t).select("query_id", F.array_join(entries, ",").alias("conditions"))


@plan("q15_complexity", f"WITH {ANALYZED} SELECT query_id, score, complexity FROM an")
def _(t):
    return analyzed(t).select("query_id", "score", "complexity")


@plan("q16_batch_with_errors", f"""WITH {EXTRACTED} SELECT query_id, CASE WHEN sql IS NULL THEN 'UNKNOWN' ELSE upper(regexp_extract(sql, '^(\\w+)', 1)) END AS query_type,
  CASE WHEN sql IS NULL THEN 'empty query' END AS error FROM ex""".replace("\\\\", "\\"))
def _(t):
    return Q.analyze_queries(extracted(t)).select("query_id", "query_type", "error")


@plan("q17_table_usage", f"""WITH {ANALYZED} SELECT table_name, count(*) AS usage, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM an), 1) AS pct
FROM (SELECT unnest(tables) AS table_name FROM an) GROUP BY 1""")
def _(t):
    return Q.table_usage(analyzed(t))


@plan("q18_join_partners", f"""WITH {UNIQUE}, p AS (SELECT main_table, list_sort(list(DISTINCT x)) AS l FROM (SELECT main_table, unnest(tables) AS x FROM uq) WHERE x <> main_table GROUP BY 1)
SELECT main_table, array_to_string(l[1:5], ', ') || CASE WHEN len(l) > 5 THEN ' (+' || (len(l) - 5) || ' more)' ELSE '' END AS joined_with, len(l) AS join_count FROM p""")
def _(t):
    return Q.join_partners(unique(t))


@plan("q19_table_sets", f"WITH {UNIQUE} SELECT array_to_string(list_sort(tables), ', ') AS table_set, count(*) AS n FROM uq WHERE len(tables) >= 2 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def _(t):
    return Q.table_sets(unique(t))


@plan("q20_business_areas", f"""WITH {AREAS} SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ar), 1) AS pct
FROM (SELECT unnest(categories) AS category FROM ar) GROUP BY 1""")
def _(t):
    return Q.area_counts(with_areas(t))


@plan("q21_complexity_bins", f"""WITH {ANALYZED} SELECT CASE WHEN floor(score) <= 3 THEN 'Simple (1-3)' WHEN floor(score) <= 10 THEN 'Medium (4-10)'
  WHEN floor(score) <= 20 THEN 'Complex (11-20)' ELSE 'Very Complex (21+)' END AS level, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM an), 1) AS pct FROM an GROUP BY 1""")
def _(t):
    return Q.complexity_bins(analyzed(t))


@plan("q22_representative_sample", f"""WITH {AREAS}, e AS (SELECT query_id, main_table, len(tables) AS table_count, score, categories, unnest(categories) AS category FROM ar),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, query_id) AS turn FROM e),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY turn, category) = 1)
SELECT query_id, main_table, CAST(table_count AS INT) AS table_count, score, array_to_string(categories, ', ') AS categories, CAST(turn AS INT) AS turn FROM o ORDER BY o.turn, category LIMIT 75""")
def _(t):
    return Q.representative_sample(with_areas(t))
