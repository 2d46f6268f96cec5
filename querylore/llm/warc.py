"""Web archives (WARC 1.1) of pages, and one global index of their captures by external merging.

Pages are written as gzip members, one record each, by the tasks that hold them. Of pages with the same payload of at least ``LEAST_BYTES``, the
one with the smallest page_id is a response and the others are revisits of it, without the payload. The archives are read back record by record:
every archive gives a run of captures, sorted by URL key, capture time and page id. Runs are cut at boundaries sampled from these
keys, so a URL with very many captures is many ranges, and the runs of a range are merged by a loser tree (``LoserTree``). Ranges follow each other, so
the whole is one capture history in order; what precedes a range, and how much of it belongs to its first URL, is carried from its predecessors.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from querylore.llm.common import stored
from querylore.sources.folders import FolderReader, FolderWriter

LEAST_BYTES = 100
ARCHIVE_BYTES = 16 << 20
RANGE_ROWS = 100_000  # captures of one merged range, about
MOST_RANGES = 32_768
DRAWS = 16  # sampled keys for each range
SALTS = 8
BATCH = 256
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# fixed values: the format's lines
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_LENGTH = "X-Payload-Length"  # an extension field: the length of the payload that a revisit stands for

RECORDS = "page_id long, url string, captured timestamp, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
CAPTURES = f"url_key string, {RECORDS}"
_NAMES = [f.split(" ")[0] for f in CAPTURES.split(", ")]
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^#]*)")
_CONTROL = re.compile("[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """The URL as archives sort it: host labels reversed, without scheme, user, port, a leading ``www.`` and fragment; ``com,example,blog)/en/1?page=2``.
    What does not look like a URL is its own key; null is empty."""
    m = _URL.match(url or "")
    if not m:
        return url or ""
    host = re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] if m[2].startswith("/") else "/" + m[2])


def record(row: dict) -> bytes:
    """A page's record, uncompressed. Control characters and blanks of a URL are percent-encoded."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = head if revisit else head + payload
    when = EPOCH + timedelta(microseconds=row["captured"])
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{_PAGE}{'' if row['page_id'] is None else row['page_id']}>"), ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%S.%fZ"))]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", row["url"])))
    fields += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), (_LENGTH, str(row["payload_bytes"]))]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_PAGE}{row['refers_to']}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return (_VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def members(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member."""
    at = 0
    while at < len(archive):
        unzip = zlib.decompressobj(31)
        content = unzip.decompress(archive[at : at + 65536])
        taken = min(65536, len(archive) - at)
        while not unzip.eof:
            if at + taken >= len(archive):
                raise ValueError("an archive ends inside a record")
            content += unzip.decompress(archive[at + taken : at + taken + 65536])
            taken = min(taken + 65536, len(archive) - at)
        size = taken - len(unzip.unused_data)
        yield at, size, content
        at += size


def _page(value: str) -> int | None:
    number = value.strip("<>").removeprefix(_PAGE)
    return int(number) if number else None


def parse(content: bytes) -> tuple[dict, bytes]:
    """The fields of a record as a row, and its payload. A response whose payload is not that of its digest is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if version != _VERSION or kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields[_LENGTH.lower()])):
        raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
    when = datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc)
    row = {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "captured": (when - EPOCH) // timedelta(microseconds=1), "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": int(fields[_LENGTH.lower()]), "payload_digest": digest,
    }
    return row, payload


class _Writer(FolderWriter):
    def files(self, batches, task):
        held, size, number = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for row in batch.slice(at, BATCH).to_pylist():
                    member = gzip.compress(record(row), 6, mtime=0)
                    held.append(member)
                    size += len(member)
                    if size >= ARCHIVE_BYTES:
                        yield f"pages-{task:06d}-{number:04d}.warc.gz", b"".join(held)
                        held, size, number = [], 0, number + 1
        if held:
            yield f"pages-{task:06d}-{number:04d}.warc.gz", b"".join(held)


def _table(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "captured": pa.timestamp("us", "UTC"), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)


class _Reader(FolderReader):
    """Captures of an archive as a run: in order of URL key, time, page id (null first) and place."""

    def rows(self, files):
        for name, archive in files:
            run = []
            for offset, length, content in members(archive):
                row, _ = parse(content)
                run.append(row | {"url_key": url_key(row["url"]), "archive": name, "offset": offset, "length": length})
            run.sort(key=_key)
            for at in range(0, len(run), 4096):
                yield _table(run[at : at + 4096], _NAMES)


class _PayloadReader(FolderReader):
    """Records with payloads, in the order of the archive."""

    def rows(self, files):
        names = [*_NAMES[1:], "payload"]
        for name, archive in files:
            for offset, length, content in members(archive):
                row, payload = parse(content)
                yield _table([row | {"archive": name, "offset": offset, "length": length, "payload": payload}], names)


class Warc(DataSource):
    """Archives in a folder: written from rows of pages, read as one sorted run of captures an archive, or with ``payloads`` as records."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return f"{RECORDS}, payload binary" if self.options.get("payloads") == "true" else CAPTURES

    def reader(self, schema):
        return (_PayloadReader if self.options.get("payloads") == "true" else _Reader)(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def _key(row: dict) -> tuple:
    none = row["page_id"] is None
    return row["url_key"].encode(), row["captured"], 0 if none else 1, 0 if none else row["page_id"], row["archive"], row["offset"]


class LoserTree:
    """Merges sorted runs: an inner node keeps the loser of the match below it, so the next head is found by one match a level. Iterating gives
    (run, position) in the order of the keys; of equal keys the smaller run comes first."""

    def __init__(self, runs: list[list]):
        self.runs, self.size = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.losers = [-1] * self.size  # the loser of each match; 0 holds the winner of all
        for run in range(len(runs)):
            self._play(run)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; a run that has ended comes last."""
        a_over, b_over = self.at[a] >= len(self.runs[a]), self.at[b] >= len(self.runs[b])
        if a_over or b_over:
            return b_over and (not a_over or a < b)
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, run: int) -> None:
        """Lets a run's head climb from its leaf; while the tree is filled, the first to come to a node waits there."""
        node = (run + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = run
                return
            if self._before(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        if not self.runs:
            return
        while True:
            run = self.losers[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def _sorted_keys(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    names = ("url_key", "captured", "page_id", "archive", "offset")
    columns = [table.column(table.schema.get_field_index(n)) for n in names]
    columns[1] = columns[1].cast(pa.int64())
    return [_key(dict(zip(names, values))) for values in zip(*[c.to_pylist() for c in columns])]


def _cut(bounds: list[tuple]):
    """Rows (range, rows): the captures of a run that lie in one range, in order, as Arrow bytes. A run ends where the order does."""

    def cut(batches):
        held: list[pa.RecordBatch] = []
        range_, last = -1, None

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([range_], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["range", "rows"])

        for batch in batches:
            keys = _sorted_keys(batch)
            places = [bisect.bisect_right(bounds, key[:4]) for key in keys]
            begin = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and places[i] == places[begin] and keys[i] > keys[i - 1]:
                    continue
                if held and (places[begin] != range_ or keys[begin] < last):
                    yield block()
                    held = []
                range_, last = places[begin], keys[i - 1]
                held.append(batch.slice(begin, i - begin))
                begin = i
        if held:
            yield block()

    return cut


def _merge(table: pa.Table) -> pa.Table:
    """The captures of a range in order, with their number in it and in the history of their URL within it."""
    parts = [pa.ipc.open_stream(rows.as_py()).read_all() for rows in table["rows"]]
    whole = pa.concat_tables(parts)
    begins, total = [], 0
    for part in parts:
        begins.append(total)
        total += part.num_rows
    order = [begins[run] + at for run, at in LoserTree([_sorted_keys(p) for p in parts])]
    whole = whole.take(pa.array(order, pa.int64()))
    numbers, before, number = [], None, 0
    for key in whole["url_key"].to_pylist():
        number = number + 1 if key == before else 1
        numbers.append(number)
        before = key
    return pa.table([pa.array([table["range"][0].as_py()] * total, pa.int32()), pa.array(range(total), pa.int64()), pa.array(numbers, pa.int64()), *whole.columns], ["range", "at", "number", *_NAMES])


def capture_rows(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """The rows that ``write_archives`` writes, for pages (page_id, url, html, ...): each page with its digest, type and, for revisits, response.

    ``captured`` is the time of capture; without one it is page_id seconds (modulo 2^32) after the start of 1970. Of rows that repeat the
    page_id of a response, all are responses; a null time is the start of 1970. Rows without a page_id revisit a page that has one; where none has, all are responses.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    when = F.timestamp_seconds(F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 32))) if captured is None else F.coalesce(captured, F.timestamp_seconds(F.lit(0)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", when.alias("captured"), html.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    large = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest")
    shared = large.agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1 AND least IS NOT NULL")
    # a payload of very many pages is joined in parts
    shared = stored(shared.select("payload_digest", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "shared-payloads")
    salt = F.pmod(F.xxhash64("page_id", "url", "captured"), F.lit(SALTS)).cast("int")
    found = rows.withColumn("salt", salt).join(shared, ["payload_digest", "salt"], "left")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    found = found.withColumn("refers_to", F.when(revisit, F.col("least")))
    payload = F.when(~revisit, F.col("payload")).alias("payload")
    return found.select("page_id", "url", F.unix_micros("captured").alias("captured"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to", "payload_bytes", "payload_digest", payload)


def write_archives(pages: DataFrame, path: str, captured: Column | None = None) -> str:
    """Writes a record for each page below ``path``, a folder that all executors share; returns it. Null html is an empty payload."""
    pages.sparkSession.dataSource.register(Warc)
    capture_rows(pages, captured).write.format("warc").mode("overwrite").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Captures as one sorted run an archive; with ``payloads`` the records and their payloads (null for revisits: see refers_to)."""
    spark.dataSource.register(Warc)
    read = spark.read.format("warc")
    if not payloads:
        return read.load(path)
    rows = read.option("payloads", "true").load(path)
    return rows.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))


def capture_histories(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures of a folder of archives in one order: ``CAPTURES`` with ``ordinal``, their place from 0 in the whole, and ``history_no``, their
    place from 1 among the captures of their URL key, by time and page id (null first).

    Captures equal in all of these follow each other in order of archive and offset. An empty folder gives an empty table.
    """
    runs = stored(read_archives(spark, path), "capture-runs")
    total = runs.count()
    ranges = max(1, min(MOST_RANGES, total // range_rows))
    every = max(1, total // (ranges * DRAWS))
    bounds: list[tuple] = []
    if ranges > 1:
        chosen = runs.filter(F.pmod(F.xxhash64("url_key", "captured", "page_id"), F.lit(every)) == 0)  # about DRAWS * MOST_RANGES keys at most
        sample = chosen.select("url_key", F.unix_micros("captured").alias("captured"), "page_id").collect()
        drawn = sorted({(r["url_key"].encode(), r["captured"], 0 if r["page_id"] is None else 1, r["page_id"] or 0) for r in sample})
        bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    blocks = runs.mapInArrow(_cut(bounds), "range int, rows binary")
    merged = stored(blocks.groupBy("range").applyInArrow(_merge, f"range int, at long, number long, {CAPTURES}"), "captures")
    # a row for each range
    ends = merged.groupBy("range").agg(F.count("*").alias("n"), F.min("url_key").alias("first"), F.max_by("url_key", "at").alias("last"), F.max_by("number", "at").alias("tail")).collect()
    begun, tail, last, table = 0, 0, None, []
    for end in sorted(ends, key=lambda e: e["range"]):
        carried = tail if end["first"] == last else 0
        table.append((end["range"], begun, end["first"], carried))
        begun += end["n"]
        tail = end["tail"] + (carried if end["first"] == end["last"] else 0)
        last = end["last"]
    before = spark.createDataFrame(table, "range int, begun long, first string, carried long")
    rows = merged.join(F.broadcast(before), "range")
    number = F.col("number") + F.when(F.col("url_key") == F.col("first"), F.col("carried")).otherwise(0)
    return rows.select(*_NAMES, (F.col("begun") + F.col("at")).alias("ordinal"), number.alias("history_no"))
