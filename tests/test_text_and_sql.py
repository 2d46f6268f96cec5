"""Exact rules of text and SQL expressions on literal rows."""

from pyspark.sql import functions as F

from querylore.functions import sqltext as S
from querylore.functions import text as X
from querylore.functions.columns import epoch_seconds, escape_pipe, percent, slug, strip
from querylore.operators import querylog as Q


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_text_helpers(spark):
    assert column(spark, [" \n a b\t\n", ""], strip) == ["a b", ""]
    assert column(spark, ["Order Management"], slug) == ["order_management"]
    assert column(spark, ["a|b|"], escape_pipe) == ["a\\|b\\|"]
    assert column(spark, ["x\n\n  y \n \nz"], X.non_blank_lines) == [["x", "y", "z"]]
    assert column(spark, ["1970-01-01 00:00:05.9", "2024-03-01 00:00:00"], lambda v: epoch_seconds(v.cast("timestamp_ntz"))) == [5, 1709251200]
    assert column(spark, [0, 4], lambda v: percent(F.lit(1), v), "int") == [0.0, 25.0]


def test_content_type_and_key(spark):
    paths = ["a/b.MD", "x.json", "noext", "a.b/c", ".md", "y.tar.gz", "p.JPEG"]
    assert column(spark, paths, X.content_type) == ["text/markdown", "application/json", None, None, None, None, "image/jpeg"]
    keys = column(spark, ["/d/a/b.md", "/d\\a\\c.md", "other.md"], lambda p: X.object_key(p, "/d/", "kb/"))
    assert keys == ["kb/a/b.md", "kb/a/c.md", "kb/other.md"]
    assert column(spark, ["/d/a.md"], lambda p: X.object_key(p, "/d", "")) == ["a.md"]


def test_url_parameters(spark):
    url = "https://h/?Application=EPIC&Company=%20ACME%20&LoginId=&Email=a%40b.c#Industry=x"
    assert [column(spark, [url], lambda u, n=n: X.query_parameter(u, n))[0] for n in ("Application", "Company", "LoginId", "Email", "Industry")] == [
        "EPIC", "ACME", None, "a@b.c", None]
    missing = column(spark, [url], lambda u: X.missing_parameters(u, X.CONTEXT_PARAMETERS))[0]
    assert missing == "DatabaseHost,DatabaseSchema,CompanyName,Industry,LoginId,FirstName,LastName"
    assert column(spark, ["Acme Inc Ltd"], X.encode_blanks) == ["Acme%20Inc%20Ltd"]


def test_extraction(spark):
    texts = [
        "# Q\n## Embedding-Ready Query\n```sql\n\n SELECT 1\nFROM a \n```\n```sql\nSELECT 2```",
        "## Embedding-Ready Query ```sql   ```", "no sql", "## Embedding-Ready Query\n```SQL\nSELECT 1```",
    ]
    assert column(spark, texts, S.embedded_query) == ["SELECT 1\nFROM a", None, None, None]
    names = ["epic10_query_1.md", "epic_a_query_b_query_2.md", "xepic1_query_1.md", "epic1-query_1.md"]
    assert column(spark, names, S.database_of_file) == ["epic10", "epic_a_query_b", "unknown", "unknown"]
    one, two, three, empty = column(spark, ["SELECT  A\n FROM b", " select a from B ", "select a from c", "  "], S.query_hash)
    assert one == two != three and empty is None


def test_tables(spark):
    assert column(spark, ["select x FROM s.t", "from  A join B JOIN a join B", "insert into x"], S.main_table) == ["s", "A", None]
    assert column(spark, ["from A join B JOIN A join C, (select 1 from Z)", "update x"], S.from_and_join_tables) == [["A", "B", "C"], []]
    assert column(spark, ["FROM a JOIN a join b"], S.table_mentions) == [["a", "a", "b"]]


def test_statement_features(spark):
    assert column(spark, ["  select 1", "WITH x AS (SELECT 1) DELETE FROM y", "with x as (select 1) select * from x", "EXPLAIN SELECT", ""],
                  lambda s: S.statement_type(S.without_comments(s))) == ["SELECT", "DELETE", "SELECT", "UNKNOWN", "UNKNOWN"]
    hidden = "SELECT 1 -- FROM c1\n/* JOIN c2 \n JOIN c3 */ FROM t WHERE n = 'x FROM c4 JOIN c5'"
    assert column(spark, [hidden], lambda s: S.all_tables(S.without_comments(s))) == [["t"]]
    found = column(spark, ["FROM a LEFT OUTER JOIN b JOIN c inner join c JOIN c"], S.joins)[0]
    assert [(j["kind"], j["table"]) for j in found] == [("LEFT", "b"), ("", "c"), ("INNER", "c")]
    where = "FROM o x WHERE x.a = 1 AND b >= 2 OR x.a=3 AND c LIKE 'z' AND d IN (1) AND e IS NULL HAVING COUNT(*) > 5"
    assert [(c["column"], c["operator"]) for c in column(spark, [where], S.conditions)[0]] == [("a", "="), ("b", ">="), ("c", "LIKE"), ("d", "IN"), ("e", "IS")]
    sides = column(spark, ["FROM db_order o JOIN db_item AS i ON o.wo = i.wo WHERE i.q > 1 AND z.k = 2 AND plain = 3"], S.condition_columns)[0]
    assert [(c["table"], c["column"]) for c in sides] == [("db_order", "wo"), ("db_item", "q"), ("z", "k"), ("db_order", "plain")]
    assert column(spark, ["a.x = b.y AND a.x = c.x"], S.qualified_columns) == [["x", "y"]]


def test_complexity_limits(spark):
    rows = [(1, "SELECT a FROM t"), (2, "SELECT a FROM t /*" + "x" * 500 + "*/"), (3, "DELETE FROM t /*" + "x" * 1000 + "*/"), (4, None), (5, "  "),
            (6, "SELECT 1 FROM a JOIN b ON a.x = b.x JOIN c ON c.x = a.x JOIN d ON d.x = 1"),
            (7, "SELECT 1 FROM a JOIN b ON a.x = b.x JOIN c ON c.x = a.x JOIN d ON d.y = 1")]
    got = {r["query_id"]: r for r in Q.analyze_queries(spark.createDataFrame(rows, "query_id int, sql string")).collect()}
    assert [got[i]["score"] for i in (1, 2, 3)] == [1.5, 2.5, 4.5]
    assert [got[i]["complexity"] for i in (1, 2, 3, 6, 7)] == ["Low", "Low", "Medium", "Medium", "High"]
    assert (got[6]["score"], got[7]["score"]) == (8.0, 8.5)
    assert got[4]["error"] == got[5]["error"] == "empty query" and got[1]["error"] is None
    assert got[4]["query_type"] == "UNKNOWN" and got[4]["tables"] == []


def test_dedup_keeps_first_and_all_databases(spark):
    block = "## Embedding-Ready Query\n```sql\n{}\n```"
    rows = [(3, "epicB_query_3.md", block.format("select 1 from a")), (1, "epicA_query_1.md", block.format("SELECT  1 FROM A")),
            (2, "other.md", block.format("select 2 from b")), (4, "epicA_query_4.md", "nothing")]
    extracted = Q.extract_sql(spark.createDataFrame(rows, "query_id int, fname string, content string"))
    unique = {r["query_id"]: r for r in Q.dedup_queries(extracted).collect()}
    assert set(unique) == {1, 2} and unique[1]["sql"] == "SELECT  1 FROM A" and unique[1]["databases"] == ["epicA", "epicB"] and unique[1]["files"] == 2
    assert tuple(Q.corpus_counts(extracted).first()) == (4, 4, 3, 2, 1)
    shared = Q.shared_queries(Q.dedup_queries(extracted)).collect()
    assert len(shared) == 1 and len(shared[0]["hash"]) == 8 and shared[0]["databases"] == "epicA, epicB"
