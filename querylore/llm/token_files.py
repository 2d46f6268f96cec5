"""Token ids as binary shard files with keyed access through minimal perfect hashes.

Documents are dealt into buckets of ascending doc_id ranges, encoded, sorted inside their bucket, and written as rows of about
``CHUNK_IDS`` ids: the raw little-endian ids of consecutive documents, and an index over them. A chunk's index is a minimal
perfect hash of its document keys (hash and displace: a key's group names a displacement, group and key name one slot out of as many
as there are keys) and, per slot, a stored fingerprint, the first id and the number of ids. The fingerprint is a one-to-one
mix of doc_id, so a lookup of a key that is not there is always noticed, and a scan can name its keys. Files are Parquet with
binary columns, because Spark's own writers are what can write to any shared store.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querylore.llm.arrays import mix, pieces
from querylore.llm.segments import Known, Pieces, column_texts, put_together, split_specials, spread_ids
from querylore.llm.sharding import _range_of

END = 2
CHUNK_IDS = 1 << 20
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 8192
BATCH_BYTES = 1 << 21
KNOWN = 2_000_000  # pieces whose ids a worker remembers, in about 30 bytes each
GROUP = 4  # keys that share a displacement, on average
_STEP = np.uint64(0xA0761D6478BD642F)
_COPY = np.uint64(0xE7037ED1A0B428DB)

FILES = "bucket int, chunk long, first_id long, last_id long, n_docs long, n_ids long, base long, payload binary, displacement binary, fingerprint binary, copy binary, begin binary, length binary"


def _unshift(h: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of h ^ (h >> bits)."""
    out = h
    for _ in range(64 // bits):
        out = h ^ (out >> np.uint64(bits))
    return out


def unmix(h: np.ndarray) -> np.ndarray:
    """Inverse of ``mix``."""
    h = _unshift(h, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = _unshift(h, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return _unshift(h, 30)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys onto 0 .. n - 1."""

    def __init__(self, displacement: np.ndarray, n: int):
        self.displacement, self.n = displacement, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        groups = max(1, -(-n // GROUP))
        displacement = np.zeros(groups, np.int64)
        if not n:
            return cls(displacement, 0)
        group = (keys % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=groups)
        ends = np.cumsum(sizes)
        free = np.ones(n, bool)
        for g in np.argsort(-sizes, kind="stable"):
            own = keys[order[ends[g] - sizes[g] : ends[g]]]
            if len(own) < 2:
                break
            base, found = 1, False
            while not found:
                tries = np.arange(base, base + 64, dtype=np.uint64)
                slots = (mix(own[None, :] + tries[:, None] * _STEP) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(1)
                for t in np.flatnonzero(good):
                    if len(np.unique(slots[t])) == len(own):
                        displacement[g], found = base + t, True
                        free[slots[t]] = False
                        break
                base += 64
        left = iter(np.flatnonzero(free).tolist())
        for g in np.flatnonzero(sizes == 1):
            displacement[g] = -next(left) - 1
        return cls(displacement, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key of the set; some slot for any other key."""
        d = self.displacement[(keys % np.uint64(len(self.displacement))).astype(np.int64)]
        hashed = (mix(keys + np.maximum(d, 0).astype(np.uint64) * _STEP) % np.uint64(max(1, self.n))).astype(np.int64)
        return np.where(d < 0, -d - 1, hashed)


def _keys(fingerprints: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return mix(fingerprints + copies.astype(np.uint64) * _COPY)


_worker: dict = {}


def _encoder(text: str):
    key = hash(text)
    if _worker.get("key") != key:
        tokenizer = Tokenizer.from_str(text)
        specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        _worker.update(key=key, tokenizer=tokenizer, specials=specials, known=Known(KNOWN))
    return _worker["tokenizer"], _worker["specials"], _worker["known"]


def _ids_of(cut: Pieces, tokenizer: Tokenizer, known: Known):
    """The public library's ids of a batch's distinct pieces (see ``Known.get``) and the number of each occurrence's piece. A worker
    asks the library for a piece once in a while; pieces are told apart by 64-bit hashes."""
    hashes, at, number = cut.distinct()

    def encode(new):
        words, found = cut.strings(at[new]), []
        for begin in range(0, len(words), 1024):
            found += [e.ids for e in tokenizer.encode_batch(words[begin : begin + 1024], add_special_tokens=False)]
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, bounds[-1]), bounds

    return *known.get(hashes, encode), number


def encode_records(docs: DataFrame, tokenizer_file: str, end: int = END, buckets: int | None = None) -> DataFrame:
    """Chunk rows (``FILES``) of the documents (doc_id, text, ...), ready to be written.

    A null text is empty and has the end id only. Rows that repeat a doc_id are records one after the other (copies 0, 1, ...); their order
    among each other is that of their ids. Rows without a doc_id have no key and are not written. Other columns are ignored.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if buckets is None:
        total = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(1, total // BUCKET_BYTES))
    bounds = texts.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    bounds = sorted({int(b) for b in bounds})

    def encode(batches):
        tokenizer, specials, known = _encoder(sent.value)
        for batch in pieces(batches, "text", BATCH_BYTES):
            segments, parts = split_specials(column_texts(batch.column(2)), specials)
            cut = Pieces(segments, spaced=True)
            flat, ends = put_together(*spread_ids(*_ids_of(cut, tokenizer, known), cut.first), parts)
            flat = flat.astype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else flat.astype("<u4")
            last = np.array([end], flat.dtype).tobytes()
            blobs = [flat[ends[i] : ends[i + 1]].tobytes() + last for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["bucket", "doc_id", "ids"])

    wide = Tokenizer.from_str(sent.value).get_vocab_size() > 1 << 16
    dealt = texts.select(_range_of(F.col("doc_id"), bounds).alias("bucket"), "doc_id", "text")
    records = dealt.mapInArrow(encode, "bucket int, doc_id long, ids binary")
    sorted_ = records.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")  # a task for each bucket
    return sorted_.mapInArrow(_packer(4 if wide else 2), FILES)


def _packer(width: int):
    def pack(batches):
        """Rows of sorted records, cut at bucket ends and when a chunk is full; only one chunk is held."""
        bucket, chunk, base, held, size, last, copy = None, 0, 0, [], 0, None, 0

        def full():
            fingerprints = mix(np.array([h[0] for h in held], np.int64).view(np.uint64))
            copies = np.array([h[1] for h in held], np.uint32)
            lengths = np.array([len(h[2]) // width for h in held], np.uint64)
            begins = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.uint64)
            perfect = PerfectHash.build(_keys(fingerprints, copies))
            to = perfect.slots(_keys(fingerprints, copies))
            columns = []
            for values in (fingerprints, copies, begins, lengths):
                placed = np.zeros_like(values)
                placed[to] = values
                columns.append([placed.tobytes()])
            ids = sum(len(h[2]) for h in held) // width
            head = [[bucket], [chunk], [held[0][0]], [held[-1][0]], [len(held)], [ids], [base], [b"".join(h[2] for h in held)], [perfect.displacement.tobytes()]]
            types = [pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * 6]
            names = [f.split(" ")[0] for f in FILES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(head + columns, types)], names)

        for batch in batches:
            for b, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and (b != bucket or size >= CHUNK_IDS * width):
                    yield full()
                    chunk, base = (chunk + 1, base + size // width) if b == bucket else (0, 0)
                    held, size = [], 0
                copy = copy + 1 if b == bucket and doc_id == last else 0
                bucket, last = b, doc_id
                held.append((doc_id, copy, ids))
                size += len(ids)
        if held:
            yield full()

    return pack


def write_records(docs: DataFrame, tokenizer_file: str, path: str, end: int = END) -> str:
    """Encodes and writes all documents below ``path``; returns it."""
    encode_records(docs, tokenizer_file, end).write.mode("overwrite").option("compression", "none").parquet(path)
    return path


def open_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


class _Chunk:
    """One row of the files: keyed access to its raw payload."""

    def __init__(self, row: dict):
        n = row["n_docs"]
        self.width = len(row["payload"]) // max(1, row["n_ids"])
        self.payload = row["payload"]
        self.fingerprint, self.begin, self.length = (np.frombuffer(row[c], np.uint64) for c in ("fingerprint", "begin", "length"))
        self.copy = np.frombuffer(row["copy"], np.uint32)
        self.perfect = PerfectHash(np.frombuffer(row["displacement"], np.int64), n)

    def find(self, doc_ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it is not here."""
        if not self.perfect.n:
            return np.full(len(doc_ids), -1)
        prints = mix(doc_ids.astype(np.int64).view(np.uint64))
        slots = self.perfect.slots(_keys(prints, copies))
        return np.where((self.fingerprint[slots] == prints) & (self.copy[slots] == copies), slots, -1)

    def ids(self, slot: int) -> np.ndarray:
        begin, length = int(self.begin[slot]), int(self.length[slot])
        return np.frombuffer(self.payload, f"<u{self.width}", length, begin * self.width).astype("<u4")


def _one_by_one(batch: pa.RecordBatch):
    """The rows of a batch, each copied when its turn comes: a chunk is several megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


_READ = "bucket int, doc_id long, copy long, begin long, ids binary"


def _rows(row: dict, doc_ids: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    chunk = _Chunk(row)
    slots = chunk.find(doc_ids, copies)
    if (slots < 0).any():
        raise ValueError("a record's key does not lead to it")
    n = len(slots)
    arrays = [pa.array([row["bucket"]] * n, pa.int32()), pa.array(doc_ids), pa.array(copies.astype(np.int64)), pa.array(chunk.begin[slots].astype(np.int64) + row["base"]), pa.array([chunk.ids(s).tobytes() for s in slots], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "doc_id", "copy", "begin", "ids"])


def read_records(files: DataFrame) -> DataFrame:
    """(doc_id, copy, start, n_ids, ids) of all records: ``start`` counts the ids of all records before, ids are little-endian 32-bit.

    Every key is looked up through its chunk's index. The ids before a chunk are what its bucket holds before it, written with
    the chunk, and the totals of the buckets before, a bounded number that is added up on the driver. No payload is shuffled.
    """

    def read(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                prints = np.frombuffer(row["fingerprint"], np.uint64)
                doc_ids, copies = unmix(prints).view(np.int64), np.frombuffer(row["copy"], np.uint32)
                for at in range(0, len(doc_ids), 512):
                    yield _rows(row, doc_ids[at : at + 512], copies[at : at + 512])

    totals = {r["bucket"]: r["n"] for r in files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
    begun, table = 0, []
    for bucket in sorted(totals):
        table.append((bucket, begun))
        begun += totals[bucket]
    before = files.sparkSession.createDataFrame(table, "bucket int, begun long")  # at most MOST_BUCKETS rows
    rows = files.mapInArrow(read, _READ).join(F.broadcast(before), "bucket")
    return rows.select("doc_id", "copy", (F.col("begun") + F.col("begin")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids")


def look_up(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the asked keys (doc_id) that are stored, copy 0 of each; only chunks that are asked are read in full.

    A key's bucket is found by the buckets' least ids, its chunk by the id ranges of that bucket's chunks; the chunk's perfect hash then leads to the record
    in constant time. Null keys and keys that are not stored give no row, repeated keys one.
    """

    def find(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                wanted = np.array(row["asked"], np.int64)
                chunk = _Chunk(row)
                slots = chunk.find(wanted, np.zeros(len(wanted), np.uint32))
                hit = slots >= 0
                yield pa.RecordBatch.from_arrays([pa.array(wanted[hit]), pa.array([chunk.ids(s).tobytes() for s in slots[hit]], pa.binary())], ["doc_id", "ids"])

    ranges = files.select(F.col("bucket").alias("_bucket"), F.col("chunk").alias("_chunk"), "first_id", "last_id")
    # buckets are ranges of ascending ids, at most MOST_BUCKETS; a key belongs to the last bucket that begins at or below it
    begins = sorted((r["first"], r["bucket"]) for r in files.groupBy("bucket").agg(F.min("first_id").alias("first")).collect())
    place = _range_of(F.col("doc_id"), [first for first, _ in begins])
    numbers = F.array(*[F.lit(bucket) for _, bucket in begins]) if begins else F.array().cast("array<int>")
    one = keys.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    one = one.withColumn("_place", place).filter("_place > 0").select("doc_id", F.get(numbers, F.col("_place") - 1).alias("_bucket"))
    # a chunk is asked for no more keys than it has documents, but for keys between its own
    asked = one.join(ranges, "_bucket").filter(F.col("doc_id").between(F.col("first_id"), F.col("last_id"))).groupBy("_bucket", "_chunk").agg(F.collect_list("doc_id").alias("asked"))
    own = files.join(asked, (F.col("bucket") == F.col("_bucket")) & (F.col("chunk") == F.col("_chunk")))
    return own.drop("_bucket", "_chunk").mapInArrow(find, "doc_id long, ids binary")
