"""Readers and writers on small files, and streaming jobs against their batch forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from querylore.operators import feedback as V
from querylore.session import scratch_dir, spread
from querylore.sources import folders as Folders
from querylore.sources import jdbc
from querylore.sources import query_files as S
from querylore.sources import stores as K
from querylore.sources.views import needed_views, with_views
from querylore.streaming import jobs as Z


def test_json_list(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"name": "a", "query": "SELECT 1"}, {"name": "b"}, {"query": "x"}, {"name": "c", "query": "SELECT\n2", "more": 1}], indent=1))
    assert sorted(tuple(r) for r in S.read_query_json(spark, str(path)).collect()) == [("a", "SELECT 1"), ("c", "SELECT\n2")]


def test_csv(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text('id,query,name\n1,"SELECT ""a"",\nb",first\n2,SELECT 2,second\n')
    bad.write_text("name,text\nx,y\n")
    assert sorted(tuple(r) for r in S.read_query_csv(spark, str(good)).collect()) == [("first", 'SELECT "a",\nb'), ("second", "SELECT 2")]
    with pytest.raises(ValueError, match="query"):
        S.read_query_csv(spark, str(bad))


def test_text_files(spark, tmp_path):
    (tmp_path / "one.sql").write_text("SELECT 1\nFROM a")
    (tmp_path / "two.md").write_text(" first \n\n\n second")
    assert {tuple(r) for r in S.read_query_text(spark, str(tmp_path)).collect()} == {("one.sql", "SELECT 1\nFROM a"), ("two.md", " first \n\n\n second")}
    assert [tuple(r) for r in S.read_markdown_folder(spark, str(tmp_path)).collect()] == [("two.md", " first \n\n\n second")]
    assert sorted(r[0] for r in S.read_query_lines(spark, str(tmp_path / "two.md")).collect()) == ["first", "second"]


def test_json_store(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, array(named_struct('x', 'y')) AS b UNION ALL SELECT 2, array()")
    path = K.write_json(df, str(tmp_path / "s"))
    (tmp_path / "s" / "part-x.json").write_text('{"a": 3, "b": [}\n{"a": 4, "b": []}\n')
    assert sorted(r["a"] for r in K.read_json(spark, path, df.schema).collect()) == [1, 2, 4]
    assert [r["line"] for r in K.broken_json(spark, path, df.schema).collect()] == ['{"a": 3, "b": [}']
    assert K.analysis_path("/x/q.json") == "/x/q_analysis.json" and K.analysis_path("/x.y/q") == "/x.y/q_analysis.json"


def test_pages_and_updates(spark, tmp_path):
    pages = spark.createDataFrame([("a/b.md", "x\ny\n"), ("c d.md", "z")], "path string, content string")
    folder = K.write_pages(pages, str(tmp_path / "pages"))
    assert sorted(tuple(r) for r in K.read_pages(spark, folder).collect()) == [("a/b.md", "x\ny\n"), ("c d.md", "z")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in K.updated_rows(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_updates_leave_other_buckets_alone(spark, tmp_path):
    import os

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")}

    rows = spark.range(500).select("id", F.concat(F.lit("v"), "id").alias("bucket"), F.lit(None).cast("string").alias("note"))
    rows = rows.withColumnRenamed("bucket", "value")
    table = K.KeyedTable.create(rows, str(tmp_path / "t"), ["id"], 16)
    before, want = files(), {r["id"]: (r["value"], r["note"]) for r in rows.collect()}
    changes = spark.createDataFrame([("new", 7, "n"), ("more", 1000, None)], "value string, id long, note string")
    written = table.update(changes)
    want |= {7: ("new", "n"), 1000: ("more", None)}
    again = K.KeyedTable(spark, str(tmp_path / "t"))
    assert {r["id"]: (r["value"], r["note"]) for r in again.read().collect()} == want and again.read().count() == 501
    after = files()
    assert all(after[f] == m for f, m in before.items()) and 1 <= len(written) <= 2
    assert {f.split("bucket=")[1].split("/")[0] for f in after if f not in before} == {str(b) for b in written}
    # an update that fails changes nothing
    broken = changes.withColumn("value", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        again.update(broken)
    assert K.KeyedTable(spark, str(tmp_path / "t")).versions == again.versions
    assert again.update(changes.limit(0)) == []
    none = K.KeyedTable.create(rows.limit(0), str(tmp_path / "none"), ["id"])
    assert none.read().count() == 0 and none.update(changes) and none.read().count() == 2


def test_connection_options():
    pg = jdbc.connection_options("h", 5432, "db", "u", "p", schema="s")
    assert pg["url"] == "jdbc:postgresql://h:5432/db" and pg["sessionInitStatement"] == 'SET search_path TO "s"'
    my = jdbc.connection_options("h", 3306, "db", "u", "p", schema="s", kind="mysql")
    assert my["url"] == "jdbc:mysql://h:3306/s" and "sessionInitStatement" not in my
    with pytest.raises(ValueError):
        jdbc.connection_options("h", 1, "db", "u", "p", kind="oracle")


class Session:
    """As much of a session as the scratch folder looks at."""

    def __init__(self, master, root=None):
        self.master, self.root = master, root
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.root if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_scratch_folder_follows_the_session(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    assert scratch_dir(Session("yarn", "hdfs://shared/check/"), "x").startswith("hdfs://shared/check/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session("yarn"), "x")


def test_spread_leaves_big_scans_alone(spark):
    assert spread(spark.range(10).repartition(1)).rdd.getNumPartitions() == 8
    assert spread(spark.range(10).repartition(16)).rdd.getNumPartitions() == 16


def test_views_are_put_in_front_once():
    text = with_views("SELECT * FROM kb_chunk JOIN text_question ON true JOIN question_log ON true")
    assert text.count("question_log AS (") == 1 and text.index("question_log AS (") < text.index("text_question AS (")
    assert with_views("WITH a AS (SELECT * FROM db_order) SELECT * FROM a").startswith("WITH db_order AS (")
    assert needed_views("select from orders join x") == ["orders"]


T0 = dt.datetime(2024, 1, 1)
FEEDBACK = "id bigint, kb_id string, company_id int, feedback_type string, original_query string, original_response string, corrected_response string, feedback_notes string, processing_status string"


@pytest.mark.parametrize("files", [1, 3, 7])
def test_incremental_training_equals_batch(spark, tmp_path, files):
    rows = [(i, "kl"[i % 2], i % 3, "correction" if i % 4 else "rating", "my orders", "bad", None if i % 5 == 0 else f"good {i}", None, "pending" if i % 6 else "applied") for i in range(100)]
    feedback = spark.createDataFrame(rows, FEEDBACK)
    feedback.repartition(files).write.parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    stream = Z.arriving(spark, str(tmp_path / "in"), feedback.schema, files_per_batch=1)
    Z.incremental_training(stream, out, checkpoint).awaitTermination()

    def rows_of(df):
        return sorted(map(str, df.collect()))
    want = rows_of(V.training_rows(feedback))
    assert rows_of(spark.read.parquet(f"{out}/training").drop("batch")) == want and want
    assert spark.read.parquet(f"{out}/log").agg(F.sum("processed")).first()[0] == len(want)
    # a later file is taken up where the job left off, nothing is done twice
    more = spark.createDataFrame([(1000, "k", 1, "correction", "x", "bad", "good", None, "pending")], FEEDBACK)
    more.write.mode("append").parquet(str(tmp_path / "in"))
    Z.incremental_training(Z.arriving(spark, str(tmp_path / "in"), feedback.schema), out, checkpoint).awaitTermination()
    assert rows_of(spark.read.parquet(f"{out}/training").drop("batch")) == sorted(want + rows_of(V.training_rows(more)))


def test_repeated_requests_are_dropped(spark, tmp_path):
    schema = "request_key string, ts timestamp"
    for n, rows in enumerate([[("a", 0), ("a", 5), ("b", 1)], [("a", 30), ("b", 59)], [("c", 400)], [("a", 401), ("a", 402)]]):
        batch = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m)) for k, m in rows], schema)
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = Z.arriving(spark, str(tmp_path / "in"), batch.schema)
        Z.first_requests(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    kept = {r["request_key"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("request_key").agg(F.count("*").alias("n")).collect()}
    # "a" is asked again long after the hour has passed
    assert kept == {"a": 2, "b": 1, "c": 1}


def _chain(seconds, ttl=3600):
    free, marks = None, {}
    for s in sorted(seconds):
        marks[s] = int(free is None or s >= free)
        free = s + ttl if marks[s] else free
    return marks


def test_reuse_on_a_stream_follows_computed_answers(spark, tmp_path):
    import random

    rng = random.Random(4)
    start = 1_700_000_000
    rows = [("hot", start + rng.randint(0, 400_000)) for _ in range(700)] + [("edge", start + x) for x in (0, 3599, 3600, 7199, 7200, 7200)] + [("one", start)]
    rng.shuffle(rows)  # every batch has rows from all over
    for n in range(5):
        batch = spark.createDataFrame(rows[n::5], "request_key string, s bigint").select("request_key", F.timestamp_seconds("s").alias("ts"))
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = Z.arriving(spark, str(tmp_path / "in"), batch.schema, 1)
    Z.reused_requests(stream, str(tmp_path / "out"), str(tmp_path / "check"), delay="30 days").awaitTermination()
    got = {(r["request_key"], r["second"]): r["computed"] for r in Z.latest_state(spark, str(tmp_path / "out"), ["request_key", "second"]).collect()}
    want = {(k, s): m for k in ("hot", "edge", "one") for s, m in _chain({s for x, s in rows if x == k}).items()}
    assert got == want


def test_reuse_on_a_stream_forgets_what_the_watermark_has_passed(spark, tmp_path):
    day, start = 86_400, 1_700_006_400 // 86_400 * 86_400
    batches = [[start + day - 10], [start + day + 100], [start + 9 * day], [start + 9 * day + 5, start + 20 * day], [start + 21 * day, start + 3]]
    for n, seconds in enumerate(batches):
        batch = spark.createDataFrame([("k", s) for s in seconds], "request_key string, s bigint").select("request_key", F.timestamp_seconds("s").alias("ts"))
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        Z.reused_requests(Z.arriving(spark, str(tmp_path / "in"), batch.schema), str(tmp_path / "out"), str(tmp_path / "check"), delay="1 day").awaitTermination()
    got = {r["second"]: r["computed"] for r in Z.latest_state(spark, str(tmp_path / "out"), ["request_key", "second"]).collect()}
    # the last batch's second row comes three weeks late
    assert got == _chain(s for b in batches for s in b if s != start + 3)


def test_folders_of_files(spark, tmp_path):
    files = spark.range(60).select(F.concat(F.lit("a b/ü "), "id", F.lit(".md")).alias("name"), F.concat(F.lit("x\n"), "id").alias("content")).repartition(7)
    path = str(tmp_path / "pages")
    want = {f"a b/ü {i}.md": f"x\n{i}".encode() for i in range(60)}
    for uri in (path, f"file://{path}"):
        Folders.write_files(files, uri)
        assert {r["name"]: bytes(r["content"]) for r in Folders.read_files(spark, uri).collect()} == want
    assert (tmp_path / "pages" / "a b" / "ü 7.md").read_text() == "x\n7"  # real files
    assert Folders.read_files(spark, Folders.write_files(files.limit(0), str(tmp_path / "none"))).count() == 0
    # a write that fails leaves what was there before, and no page of its own
    broken = files.withColumn("content", F.lit("new")).unionByName(spark.createDataFrame([("../up", "y")], "name string, content string"))
    with pytest.raises(Exception, match="not a file name"):
        Folders.write_files(broken, path)
    assert {r["name"]: bytes(r["content"]) for r in Folders.read_files(spark, path).collect()} == want
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none", "pages"]
    # files of any other origin are listed
    plain = tmp_path / "plain" / "sub"
    plain.mkdir(parents=True)
    (plain / "q.sql").write_text("SELECT 1")
    (plain.parent / "_hidden").write_text("x")
    assert [(r["name"], bytes(r["content"])) for r in Folders.read_files(spark, str(tmp_path / "plain")).collect()] == [("sub/q.sql", b"SELECT 1")]


def test_running_counts(spark, tmp_path):
    schema = "company_id int, message_type string, content string, created_at timestamp"
    rows = [(i % 2, "user" if i % 3 else "assistant", f"q{i % 4}", T0 + dt.timedelta(minutes=7 * i)) for i in range(90)]
    messages = spark.createDataFrame(rows, schema)
    messages.repartition(5).write.parquet(str(tmp_path / "in"))
    Z.running_analytics(Z.arriving(spark, str(tmp_path / "in"), messages.schema, 1), str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    got = {(r["company_id"], r["question_hash"]): (r["use_count"], r["first_used"], r["last_used"]) for r in Z.latest_state(spark, str(tmp_path / "a"), ["company_id", "question_hash"]).collect()}
    want = {(r[0], r[1]): tuple(r)[2:] for r in messages.filter("message_type = 'user'").groupBy("company_id", F.md5("content")).agg(F.count("*"), F.min("created_at"), F.max("created_at")).collect()}
    assert got == want
    Z.hourly_analytics(Z.arriving(spark, str(tmp_path / "in"), messages.schema, 1), str(tmp_path / "h"), str(tmp_path / "ch"), "2 days").awaitTermination()
    assert Z.latest_state(spark, str(tmp_path / "h"), ["company_id", "hour_start"]).agg(F.sum("messages")).first()[0] == 90


def test_a_task_makes_each_folder_once_and_none_after_an_abort(tmp_path, monkeypatch):
    import pyarrow as pa

    made, writer = [], Folders._NamedWriter(str(tmp_path / "pages"), True)

    class Store:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def create_dir(self, path, recursive=True):
            made.append(path)
            self.store.create_dir(path, recursive=recursive)

    store = Folders._store
    monkeypatch.setattr(Folders, "_store", lambda path: (Store(store(path)[0]), store(path)[1]))
    monkeypatch.setattr(Folders, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))

    def batch(first):
        return pa.RecordBatch.from_arrays([pa.array([f"a/{first + i}.md" for i in range(20)]), pa.array([b"x"] * 20)], ["name", "content"])

    def rows():
        yield batch(0)
        yield batch(20)

    assert writer.write(rows()).files == 40 and len(made) == len(set(made)) == 2

    def stopped():
        yield batch(40)
        writer.abort([])
        yield batch(60)
    with pytest.raises(FileNotFoundError):
        writer.write(stopped())
    assert list(tmp_path.iterdir()) == []


def test_a_task_that_starts_after_an_abort_makes_nothing(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(Folders, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    writer = Folders._NamedWriter(str(tmp_path / "pages"), True)
    writer.abort([])
    with pytest.raises(FileNotFoundError, match="has ended"):
        writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["a/b.md"]), pa.array([b"x"])], ["name", "content"])]))
    assert list(tmp_path.iterdir()) == []


def test_a_free_place_is_written_without_a_rename_and_half_a_file_is_replaced(tmp_path, monkeypatch):
    import pyarrow as pa

    renamed, put = [], Folders._put
    monkeypatch.setattr(Folders, "_put", lambda store, path, *more: (renamed.append(path), put(store, path, *more)))
    monkeypatch.setattr(Folders, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    writer = Folders._NamedWriter(str(tmp_path / "pages"), True)
    (half := tmp_path / writer.unseen / "a" / "3.md").parent.mkdir()
    half.write_bytes(b"half of a longer fi")  # by a task that was killed
    names = [*(f"a/{i}.md" for i in range(20)), "a/b/c.md", "a/7.md"]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([b"x" * i for i in range(22)])], ["name", "content"])
    assert writer.write(iter([batch])).files == 22
    assert [r.removeprefix(writer.unseen) for r in renamed] == ["/a/3.md", "/a/7.md", "/_list/000000-000000"]
    writer.commit([])
    files = {str(f.relative_to(tmp_path / "pages")): f.read_bytes() for f in (tmp_path / "pages" / "a").rglob("*") if f.is_file()}
    assert files == {n: b"x" * i for i, n in enumerate(names)}


def test_query_files_are_dealt_to_folders(spark, tmp_path):
    files = spark.range(300).select(F.concat(F.lit("q_"), "id", F.lit(".md")).alias("fname"), F.concat(F.lit("SELECT "), "id").alias("content"))
    path = K.write_pages(files.select(Folders.dealt_name(F.col("fname")).alias("path"), "content"), str(tmp_path / "q"))
    assert {tuple(r) for r in S.read_query_text(spark, path).collect()} == {(f"q_{i}.md", f"SELECT {i}") for i in range(300)}
    folders = [f for f in (tmp_path / "q").iterdir() if f.name != Folders.LIST]
    assert 100 < len(folders) <= 256 and all(f.is_dir() and len(list(f.iterdir())) < 20 for f in folders)


def test_files_reach_spark_in_batches():
    reader = Folders._NamedReader("/nowhere")
    small = list(reader.rows((f"{i}", b"x") for i in range(2_500)))
    assert [b.num_rows for b in small] == [1_000, 1_000, 500]
    assert [n for b in small for n in b.column(0).to_pylist()] == [f"{i}" for i in range(2_500)]
    large = list(reader.rows((f"{i}", b"x" * Folders.BATCH_BYTES) for i in range(3)))
    assert [b.num_rows for b in large] == [1, 1, 1] and list(reader.rows(iter([]))) == []
