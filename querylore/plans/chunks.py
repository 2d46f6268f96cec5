"""Chunking and its DuckDB twins."""

from pyspark.sql import functions as F

from querylore.operators import catalog as C
from querylore.operators import chunking as D
from querylore.plans.catalog import DOC_SQL, _documents
from querylore.plans.registry import plan
from querylore.session import spread

WORDS = r"w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM documents)"


def _hierarchy_sql(parent: int, child: int, overlap: int) -> str:
    step = child - overlap
    return rf"""WITH {WORDS},
p AS (SELECT doc_id, words, unnest(range(0, len(words), {parent})) AS ps FROM w),
q AS (SELECT doc_id, ps // {parent} AS parent_no, words[ps + 1:ps + {parent}] AS pw FROM p),
c AS (SELECT doc_id, parent_no, pw, unnest(list_filter(range(0, len(pw), {step}), lambda s: s = 0 OR s + {overlap} < len(pw))) AS s FROM q)
SELECT doc_id, CAST(parent_no AS INT) AS parent_no, CAST(s // {step} AS INT) AS child_no, CAST(len(pw[s + 1:s + {child}]) AS INT) AS token_count,
  md5(array_to_string(pw[s + 1:s + {child}], ' ')) AS chunk FROM c"""


def _hashed(chunks):
    return chunks.withColumn("chunk", F.md5("chunk"))


@plan("d01_hierarchical_chunks", _hierarchy_sql(4000, 800, 150))
def _(t):
    return _hashed(D.hierarchical_chunks(spread(t.documents), *D.DEFAULT_SIZES))


@plan("d02_migrated_chunks", _hierarchy_sql(512, 300, 50))
def _(t):
    return _hashed(D.hierarchical_chunks(spread(t.documents), *D.MIGRATED_SIZES))


@plan("d03_fixed_chunks", rf"""WITH {WORDS}, c AS (SELECT doc_id, words, unnest(list_filter(range(0, len(words), 280), lambda s: s = 0 OR s + 20 < len(words))) AS s FROM w)
SELECT doc_id, CAST(s // 280 AS INT) AS chunk_no, CAST(len(words[s + 1:s + 300]) AS INT) AS token_count, md5(array_to_string(words[s + 1:s + 300], ' ')) AS chunk FROM c""")
def _(t):
    return _hashed(D.fixed_chunks(spread(t.documents), *D.FIXED_SIZES))


@plan("d04_marked_blocks", rf"""{DOC_SQL}, b AS (SELECT tenant, table_name, regexp_extract_all(content, '\[QUERY_EXAMPLE\](.*?)\[/QUERY_EXAMPLE\]', 1, 's') AS l FROM docs)
SELECT tenant, table_name, CAST(unnest(range(len(l))) AS INT) AS block_no, unnest(l) AS block FROM b""")
def _(t):
    return D.marked_blocks(C.table_documents(_documents(t)), "QUERY_EXAMPLE", ["tenant", "table_name"])


@plan("d04_table_blocks", rf"""{DOC_SQL}, b AS (SELECT tenant, table_name, regexp_extract_all(content, '\[TABLE: \w+\](.*?)\[/TABLE: \w+\]', 1, 's') AS l FROM docs)
SELECT tenant, table_name, CAST(unnest(range(len(l))) AS INT) AS block_no, md5(unnest(l)) AS block FROM b""")
def _(t):
    return D.marked_blocks(C.table_documents(_documents(t)), "TABLE", ["tenant", "table_name"]).withColumn("block", F.md5("block"))


@plan("d05_load_report", r"""
SELECT count(*) AS scanned, count(*) FILTER (WHERE regexp_matches(text, '\S')) AS indexed, count(*) FILTER (WHERE NOT regexp_matches(text, '\S')) AS failed
FROM (SELECT text FROM documents UNION ALL SELECT regexp_extract(html, '<title>(.*?)</title>', 1, 's') FROM pages)""")
def _(t):
    titles = t.pages.select(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("text"))
    return D.load_report(t.documents.select("text").unionByName(titles))
