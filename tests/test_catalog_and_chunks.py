"""Catalog documents and chunk windows against plain loops."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylore.operators import catalog as C
from querylore.operators import chunking as D


def catalog(spark):
    tables = spark.createDataFrame([("t", "a", "", "BASE TABLE"), ("t", "b", "say | so", "BASE TABLE"), ("t", "v", "view", "VIEW"), ("u", "a", None, "BASE TABLE")],
                                   "tenant string, table_name string, table_comment string, table_type string")
    cols = spark.createDataFrame(
        [("t", "a", 1, "z", "int", None, 0, 0, "NO", None, ""), ("t", "a", 2, "k", "varchar", 25, None, None, "YES", "x|y", "kk"),
         ("t", "b", 1, "id", "decimal", 0, 10, 2, "NO", None, None), ("t", "b", 2, "ref", "bigint", None, 64, 0, "YES", None, None), ("t", "v", 1, "q", "int", None, None, None, "NO", None, None)],
        "tenant string, table_name string, ordinal int, column_name string, data_type string, char_len int, num_precision int, num_scale int, is_nullable string, column_default string, column_comment string")
    keys = spark.createDataFrame(
        [("t", "a", 2, "z", "PRIMARY", None, None), ("t", "a", 1, "k", "PRIMARY", None, None), ("t", "b", 1, "ref", "fk_1", "a", "k"), ("t", "b", 1, "ref", "fk_2", "a", "z"),
         ("t", "b", 1, "id", "fk_v", "v", "q"), ("t", "b", 1, "id", "fk_x", "gone", "q"), ("u", "a", 1, "ref", "fk_1", "b", "id")],
        "tenant string, table_name string, ordinal int, column_name string, constraint_name string, ref_table string, ref_column string")
    idx = spark.createDataFrame([("t", "a", "PRIMARY", 1, "z", 0), ("t", "b", "i", 2, "id", 1), ("t", "b", "i", 1, "ref", 1), ("t", "v", "i", 1, "q", 1)],
                                "tenant string, table_name string, index_name string, seq int, column_name string, non_unique int")
    return tables, cols, keys, idx


def test_full_types(spark):
    tables, cols, _, _ = catalog(spark)
    got = {(r["table_name"], r["column_name"]): r["data_type"] for r in C.columns(tables, cols).collect()}
    assert got == {("a", "z"): "int", ("a", "k"): "varchar(25)", ("b", "id"): "decimal(10,2)", ("b", "ref"): "bigint(64)"}


def test_keys_and_edges(spark):
    tables, cols, keys, _ = catalog(spark)
    assert [r["primary_key"] for r in C.primary_keys(tables, keys).collect()] == ["k,z"]
    assert [r["primary_key"] for r in C.primary_keys(tables, keys, cols).collect()] == ["z,k"]
    edges = C.foreign_keys(tables, keys)
    # views, dropped tables and tables of another tenant are unknown
    assert sorted((r["tenant"], r["constraint_name"]) for r in edges.collect()) == [("t", "fk_1"), ("t", "fk_2")]
    last = C.column_references(edges).collect()
    assert [(r["column_name"], r["ref_column"]) for r in last] == [("ref", "z")]
    joins = {(r["table_name"], r["own_column"], r["other_table"], r["other_column"]) for r in C.suggested_joins(tables, keys).collect()}
    assert joins == {("b", "ref", "a", "k"), ("b", "ref", "a", "z"), ("a", "k", "b", "ref")}


def test_documents(spark):
    documents = C.schema_documents(*catalog(spark))
    rows = {(r["tenant"], r["table_name"]): r for r in documents.collect()}
    assert len(rows) == 3
    empty = rows["u", "a"]
    assert empty["columns"] == [] and empty["primary_key"] == [] and empty["foreign_keys"] == [] and empty["indexes"] == [] and empty["referenced_by"] == []
    assert empty["description"] == "Table a" and len(rows["t", "a"]["referenced_by"]) == 2
    texts = {(r["tenant"], r["table_name"]): r["content"] for r in C.table_documents(documents).collect()}
    a, b, u = texts["t", "a"], texts["t", "b"], texts["u", "a"]
    assert a.startswith("[TABLE: a]\n# Table: a\n\nTable a\n\n## Quick Statistics\n\n- **Columns**: 2\n- **Primary Key**: k, z\n") and a.endswith("[/TABLE: a]\n")
    # sorted by name, default escaped, marks
    assert a.index("| k | varchar(25) | YES | x\\|y | kk | ✓ |  |  |") < a.index("| z | int | NO | NULL | Column z in a | ✓ |  | ✓ |")
    assert "| i | ref, id |  |  |" in b and "say | so" in b and b.count("[QUERY_EXAMPLE]") == 2
    assert "JOIN b t2 ON t1.k = t2.ref\n" in a and a.count("(referencing)") == 2
    assert "## Foreign Keys" not in u and u.endswith("## Common Join Patterns\n\n[/TABLE: a]\n") and "- **Primary Key**: None" in u
    blocks = D.marked_blocks(C.table_documents(documents), "QUERY_EXAMPLE", ["tenant", "table_name"]).filter("table_name = 'b'").orderBy("block_no").collect()
    assert [r["block_no"] for r in blocks] == [0, 1] and blocks[0]["block"].startswith("\n```sql\nSELECT t1.*, t2.*\nFROM b t1\n")
    summary = {(r["tenant"], r["table_name"]): r for r in C.tables_summary(documents).collect()}
    assert summary["t", "b"]["description"] == "say \\| so" and summary["u", "a"]["primary_key"] == "None"


def windows(words, size, overlap):
    starts = [s for s in range(0, len(words), size - overlap) if s == 0 or s + overlap < len(words)]
    return [words[s:s + size] for s in starts]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(2, 9), st.data())
def test_chunks_equal_loops(spark, lengths, child, data):
    overlap, parent = data.draw(st.integers(0, child - 1)), data.draw(st.integers(1, 30))
    texts = [(i, "  " + " \n".join(f"w{j}" for j in range(n))) for i, n in enumerate(lengths)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    want, flat = [], []
    for i, text in texts:
        words = text.split()
        for p, start in enumerate(range(0, len(words), parent)):
            want += [(i, p, c, len(w), " ".join(w)) for c, w in enumerate(windows(words[start:start + parent], child, overlap))]
        flat += [(i, c, len(w), " ".join(w)) for c, w in enumerate(windows(words, child, overlap))]
    assert sorted(tuple(r) for r in D.hierarchical_chunks(docs, parent, child, overlap).collect()) == sorted(want)
    assert sorted(tuple(r) for r in D.fixed_chunks(docs, child, overlap).collect()) == sorted(flat)


def test_chunk_constants_and_report(spark):
    assert (D.DEFAULT_SIZES, D.MIGRATED_SIZES, D.FIXED_SIZES) == ((4000, 800, 150), (512, 300, 50), (300, 20))
    docs = spark.createDataFrame([(1, "a b"), (2, " \n"), (3, None), (4, "")], "doc_id int, text string")
    assert tuple(D.load_report(docs).first()) == (4, 1, 3)
    assert D.hierarchical_chunks(docs).select("doc_id", "chunk").collect()[0] == (1, "a b")
    assert docs.select(F.size(D.tokens(F.col("text")))).first()[0] == 2


def test_no_catalog_table_is_sent_whole_to_every_task(spark):
    # rows made by inline look as few as the rows they are made from, so Spark takes the table for a small one
    customers = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "t")], "tenant string, table_name string")
    tables = customers.selectExpr("*", "'' AS table_comment", "'BASE TABLE' AS table_type")
    cols = customers.selectExpr("*", "1 AS ordinal", "'id' AS column_name", "'int' AS data_type", "0 AS char_len", "0 AS num_precision", "0 AS num_scale",
                                "'NO' AS is_nullable", "'' AS column_default", "'' AS column_comment")
    keys = customers.selectExpr("*", "1 AS ordinal", "'id' AS column_name", "inline(array(struct('PRIMARY' AS constraint_name, CAST(NULL AS STRING) AS ref_table, "
                                "CAST(NULL AS STRING) AS ref_column), struct('f' AS constraint_name, 't' AS ref_table, 'id' AS ref_column)))")
    idx = customers.selectExpr("*", "'PRIMARY' AS index_name", "1 AS seq", "'id' AS column_name", "0 AS non_unique")
    found = {
        "c03": C.primary_keys(tables, keys, cols), "c04": C.column_references(C.foreign_keys(tables, keys)), "c05": C.flagged_columns(tables, cols, keys, idx),
        "c06": C.schema_documents(tables, cols, keys, idx), "c07": C.ordered_edges(C.relationship_edges(tables, keys)), "c10": C.suggested_joins(tables, keys)}
    for name, df in found.items():
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
    assert {tuple(r) for r in found["c03"].collect()} == {("a", "t", "id"), ("a", "u", "id"), ("b", "t", "id")}
    assert found["c07"].count() == 3


def test_columns_by_index_are_merged_not_sent_whole(spark):
    from types import SimpleNamespace

    from querylore.plans.registry import all_plans

    named = spark.createDataFrame([("a", "t", "id"), ("a", "t", "x"), (None, "t", "id")], "tenant string, table_name string, column_name string")
    plan = all_plans()["j10_array_membership"]
    got = plan.build(SimpleNamespace(cat_index=named.withColumn("index_name", F.lit("i")).filter("column_name = 'id'"), cat_column=named))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r[c] for c in ("tenant", "table_name", "column_name", "index_name")) for r in got.collect()] == [("a", "t", "id", "i")]
