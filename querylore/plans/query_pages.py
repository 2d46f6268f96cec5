"""Pages about the query corpus and their DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import catalog as C
from querylore.operators import pages as P
from querylore.plans.query_log import AREAS, with_areas
from querylore.plans.registry import plan

PAGES = rf"""{AREAS},
pg AS (SELECT query_id, sql AS query_text, main_table, tables, joins, clean, complexity, categories[1] AS category FROM ar),
pt AS (SELECT query_id, category, complexity, query_text, unnest(tables) AS table_name FROM pg),
tot AS (SELECT category, count(*) AS total FROM pg GROUP BY 1),
used AS (SELECT table_name, count(*) AS total FROM pt GROUP BY 1 HAVING count(*) >= 2),
pairs AS (SELECT query_id, coalesce(main_table, '') AS a, regexp_extract(j, '(\w+)$', 1) AS b FROM (SELECT query_id, main_table, unnest(joins) AS j FROM pg))"""
PCT = "round(n * 100.0::DOUBLE / total, 1) AS pct"


def page_queries(t):
    return P.page_input(with_areas(t))


@plan("q23_front_categories", f"WITH {PAGES} SELECT category, count(*) AS n, 'query_patterns/' || replace(lower(category), ' ', '_') || '.md' AS path FROM pg GROUP BY 1")
def _(t):
    return P.front_categories(page_queries(t))


@plan("q23_front_tables", f"WITH {PAGES} SELECT table_name, count(*) AS n, 'tables_usage/' || lower(table_name) || '.md' AS path FROM pt GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def _(t):
    return P.front_tables(page_queries(t))


@plan("q24_category_levels", f"""WITH {PAGES}, lv AS (SELECT * FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High'), (3, 'Very High')) AS v(level_no, complexity)),
c AS (SELECT category, complexity, count(*) AS n FROM pg GROUP BY 1, 2),
x AS (SELECT t.category, t.total, lv.level_no, lv.complexity, coalesce(c.n, 0) AS n FROM tot t CROSS JOIN lv LEFT JOIN c ON c.category = t.category AND c.complexity = lv.complexity)
SELECT category, level_no, complexity, n, {PCT}, printf('%.1f%%', n::DOUBLE / total * 100) AS pct_text FROM x""")
def _(t):
    return P.category_levels(page_queries(t))


@plan("q24_category_tables", f"""WITH {PAGES}, c AS (SELECT category, table_name, count(*) AS n FROM pt GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, table_name) AS INT) AS position FROM c)
SELECT r.category, position, table_name, n, {PCT}, printf('%.1f%%', n::DOUBLE / total * 100) AS pct_text FROM r JOIN tot ON r.category = tot.category WHERE position <= 15""")
def _(t):
    return P.category_tables(page_queries(t))


@plan("q24_category_samples", f"""WITH {PAGES}, r AS (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY complexity, query_id) AS INT) AS position,
  query_id, complexity, array_to_string(tables, ', ') AS tables, query_text FROM pg) SELECT * FROM r WHERE position <= 20""")
def _(t):
    return P.category_samples(page_queries(t))


@plan("q25_table_overview", f"""WITH {PAGES}, k AS (SELECT table_name, min(coalesce(nullif(table_comment, ''), 'Table ' || table_name)) AS description FROM cat_table WHERE table_type = 'BASE TABLE' GROUP BY 1)
SELECT used.table_name, total, description FROM used LEFT JOIN k ON used.table_name = k.table_name""")
def _(t):
    return P.table_overview(page_queries(t), C.base_tables(t.cat_table))


@plan("q25_table_categories", f"""WITH {PAGES}, c AS (SELECT table_name, category, count(*) AS n FROM pt GROUP BY 1, 2)
SELECT c.table_name, category, n, {PCT} FROM c JOIN used ON c.table_name = used.table_name""")
def _(t):
    return P.table_categories(page_queries(t))


PARTNERS = f"""WITH {PAGES}, x AS (SELECT a AS table_name, b AS partner FROM pairs UNION ALL SELECT b, a FROM pairs WHERE a <> b),
c AS (SELECT table_name, partner, count(*) AS n FROM x GROUP BY 1, 2)"""


@plan("q25_table_partners", f"{PARTNERS} SELECT c.table_name, partner, n, {PCT} FROM c JOIN used ON c.table_name = used.table_name")
def _(t):
    return P.table_partners(page_queries(t))


FILTERS = rf"""w AS (SELECT query_id, clean, main_table, unnest(regexp_extract_all(clean, '(?i)\b(?:WHERE|AND|OR|ON)\s+((?:\w+\.)?\w+\s*(?:>=|<=|<>|!=|=|>|<|\bIN\b|\bLIKE\b|\bBETWEEN\b|\bIS\b))', 1)) AS c FROM pg),
al AS (SELECT query_id, pos, regexp_extract(x, '^(\w+)', 1) AS tab, regexp_extract(x, '(\w+)$', 1) AS ali FROM (SELECT query_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT query_id, regexp_extract_all(clean, '(?i)\b(?:FROM|JOIN)\s+(\w+\s+(?:AS\s+)?\w+)', 1) AS l FROM pg))),
a1 AS (SELECT query_id, ali, arg_min(tab, pos) AS tab FROM al GROUP BY 1, 2),
d AS (SELECT DISTINCT w.query_id, coalesce(a1.tab, nullif(regexp_extract(w.c, '^(\w+)\.', 1), ''), w.main_table) AS table_name, regexp_extract(w.c, '^(?:\w+\.)?(\w+)', 1) AS col
  FROM w LEFT JOIN a1 ON w.query_id = a1.query_id AND a1.ali = regexp_extract(w.c, '^(\w+)\.', 1)),
c AS (SELECT table_name, col AS "column", count(*) AS n FROM d WHERE table_name IS NOT NULL GROUP BY 1, 2),
r AS (SELECT c.table_name, CAST(row_number() OVER (PARTITION BY c.table_name ORDER BY n DESC, "column") AS INT) AS position, "column", n, total FROM c JOIN used ON c.table_name = used.table_name)"""


@plan("q25_table_filters", f"WITH {PAGES}, {FILTERS} SELECT table_name, position, \"column\", n, {PCT} FROM r WHERE position <= 10")
def _(t):
    return P.table_filters(page_queries(t))


@plan("q25_table_samples", f"""WITH {PAGES}, r AS (SELECT pt.table_name, CAST(row_number() OVER (PARTITION BY pt.table_name ORDER BY complexity, query_id) AS INT) AS position, query_id, complexity, category, query_text
FROM pt JOIN used ON pt.table_name = used.table_name) SELECT * FROM r WHERE position <= 10""")
def _(t):
    return P.table_samples(page_queries(t))


@plan("q26_join_partner", f"""WITH {PAGES} SELECT query_id, a || '_JOIN_' || b AS pair, a AS table_name, b AS partner FROM pairs""")
def _(t):
    pairs = page_queries(t).select("query_id", F.explode("join_pairs").alias("pair"))
    table = F.split("pair", "_JOIN_")[0]
    return pairs.select("query_id", "pair", table.alias("table_name"), P.join_partner(F.col("pair"), table).alias("partner"))
