"""Phrases whose words occur together more often than apart, counted in quotient filters.

Words are counted for each language; only words that are frequent enough themselves can be part of a phrase, and get ids. Texts are then written
once as streams of ids with a mark wherever a piece ends or a rare word stands. Each task counts the n-grams of its streams in
counting quotient filters (quotient_filter.py) and cuts them at ranges of quotients; the filters of a range are merged across tasks. The
permutation deals n-grams alike over the ranges, and a task has one counter for a phrase however often it occurs, so no
phrase is a hot key. Two words are counted first: a longer n-gram is counted where all its neighbours are frequent pairs, which a bitmap over
permuted pairs tells (a pair it names wrongly costs time, never a count).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylore.llm.arrays import _BYTE, _LOWER, mix, pieces, span_hashes, text_bytes
from querylore.llm.common import stored
from querylore.llm.quotient_filter import Packing, QuotientFilter
from querylore.operators.relational import number_rows

LEAST = 100
LONGEST = 5
TOP = 2000
SHARED_WORDS = 2_000_000  # words with ids that may be sent to every task, in about 40 bytes each; beyond, ids come by a join
RANGE_GRAMS = 1 << 22  # n-gram occurrences of one range of quotients, before any are counted together
LEAST_RANGE_BITS = 5
HELD = 1 << 21  # keys a task gathers before it sorts them, and distinct ones before it hands them on
PAIR_BITS, MOST_PAIR_BITS = 4, 30  # bitmap cells for each frequent pair (power of two), and cells at most: 128 MB
BUCKET = 32768  # cells of one row of Spark's bitmap functions
SALTS = 64
STOP = -1

# fixed values: what parts pieces, and what parts words
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = _ENDS.copy()
_BLANK[[32, 9]] = True
_OTHER = mix(np.arange(300, 556, dtype=np.uint64))  # a second value of each byte, for a second hash


class _Cut:
    """The words of a string column: spans over ``data``, two hashes and the number of the piece of each; rows part pieces."""

    def __init__(self, texts: pa.Array):
        raw, bounds = text_bytes(texts)
        data = _LOWER[raw]
        n = len(data)
        blank = _BLANK[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.ones(n, bool)
        before[1:] = blank[:-1]
        after = np.ones(n, bool)
        after[:-1] = blank[1:]
        self.data = data
        self.starts = np.flatnonzero(~blank & (before | edge[:n]))
        self.ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
        first = np.searchsorted(self.starts, bounds)
        self.row = np.repeat(np.arange(len(texts)), np.diff(first))
        self.piece = np.concatenate([[0], np.cumsum(_ENDS[data])])[self.starts] + self.row

    def hashes(self, languages: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        return mix(span_hashes(bytes_[self.data], self.starts, self.ends) + languages[self.row])

    def words(self, at: np.ndarray) -> pa.Array:
        whole = self.data.tobytes()
        return pa.array([whole[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())], pa.binary()).cast(pa.string())


def _language_hashes(column: pa.Array, bytes_: np.ndarray) -> np.ndarray:
    data, bounds = text_bytes(column)
    return mix(span_hashes(bytes_[data], bounds[:-1], bounds[1:]) + np.uint64(len(bytes_)))  # a language may be named like a word


def _count_words(batches):
    """(lang, word, n), and under a null word all words of the language."""
    for batch in pieces(batches, "text"):
        cut = _Cut(batch.column(1))
        names = batch.column(0).to_pylist()
        _, at, number = np.unique(cut.hashes(_language_hashes(batch.column(0), _BYTE), _BYTE), return_index=True, return_inverse=True)
        langs = [names[r] for r in cut.row[at].tolist()]
        all_of: dict[str, int] = {}
        for r, n in enumerate(np.bincount(cut.row, minlength=len(names)).tolist()):
            all_of[names[r]] = all_of.get(names[r], 0) + n
        words = pa.concat_arrays([cut.words(at), pa.nulls(len(all_of), pa.string())])
        counts = [*np.bincount(number, minlength=len(at)).tolist(), *all_of.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*langs, *all_of], pa.string()), words, pa.array(counts, pa.int64())], ["lang", "word", "n"])


class _Ids:
    """Ids of the words of a vocabulary, found by two hashes of 64 bits."""

    def __init__(self, table: pa.Table):
        self.size = table.num_rows
        words = pa.concat_arrays(table["word"].chunks) if self.size else pa.array([], pa.string())
        langs = pa.concat_arrays(table["lang"].chunks) if self.size else pa.array([], pa.string())
        keys = []
        for bytes_ in (_BYTE, _OTHER):
            data, bounds = text_bytes(words)
            keys.append(mix(span_hashes(bytes_[data], bounds[:-1], bounds[1:]) + _language_hashes(langs, bytes_)))
        order = np.argsort(keys[0])
        self.first, self.second, self.ids = keys[0][order], keys[1][order], table["id"].to_numpy()[order].astype(np.int64)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The id of each word, ``STOP`` for words without one."""
        if not self.size:
            return np.full(len(first), STOP)
        at = np.minimum(np.searchsorted(self.first, first), self.size - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), self.ids[at], STOP)


_worker: dict = {}


def _tool(kind: str, key: str, make):
    if _worker.get(kind, (None,))[0] != key:
        _worker[kind] = (key, make())
    return _worker[kind][1]


def _stream(ids: np.ndarray, piece: np.ndarray) -> bytes:
    """Ids with one mark between words that are not neighbours; marks in a row are one."""
    out = np.full(2 * len(ids), STOP, np.int32)
    out[0::2] = ids
    inner = np.ones(len(out), bool)
    inner[1:-1:2] = piece[1:] != piece[:-1]
    out = out[inner]
    return out[(out != STOP) | np.concatenate([[True], out[:-1] != STOP])].tobytes()


def _streams(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(ids binary): the texts as streams of word ids, about a megabyte of text in each."""
    if words.count() <= SHARED_WORDS:
        sent = words.sparkSession.sparkContext.broadcast(words.select("id", "lang", "word").toArrow())
        key = f"{words.sparkSession.sparkContext.applicationId}-{sent._jbroadcast.id()}"

        def write(batches):
            ids = _tool("ids", key, lambda: _Ids(sent.value))
            for batch in pieces(batches, "text"):
                cut = _Cut(batch.column(1))
                first, second = (cut.hashes(_language_hashes(batch.column(0), b), b) for b in (_BYTE, _OTHER))
                yield pa.RecordBatch.from_arrays([pa.array([_stream(ids.of(first, second), cut.piece)], pa.binary())], ["ids"])

        return texts.mapInArrow(write, "ids binary")

    def spread(batches):
        for batch in pieces(batches, "text"):
            cut = _Cut(batch.column(1))
            langs = batch.column(0).take(pa.array(cut.row))
            yield pa.RecordBatch.from_arrays([pa.array(cut.row), pa.array(np.arange(len(cut.row))), pa.array(cut.piece), langs, cut.words(np.arange(len(cut.row)))], ["row", "at", "piece", "lang", "word"])

    def gather(table: pa.Table) -> pa.Table:
        order = np.argsort(table["at"].to_numpy(), kind="stable")
        return pa.table({"ids": pa.array([_stream(table["id"].to_numpy()[order], table["piece"].to_numpy()[order])], pa.binary())})

    # a text is the group: its words come back in order whatever tasks they went through
    numbered = texts.withColumn("text_id", F.monotonically_increasing_id())
    each = stored(numbered, "numbered-texts")

    def own(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                for part in spread(iter([one.select(["lang", "text"])])):
                    yield pa.RecordBatch.from_arrays([one.column(2).take(pa.array(np.zeros(part.num_rows, np.int64))), *part.columns[1:]], ["text_id", "at", "piece", "lang", "word"])

    rows = each.mapInArrow(own, "text_id long, at long, piece long, lang string, word string")
    named = rows.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    return named.select("text_id", "at", "piece", F.coalesce("id", F.lit(STOP)).alias("id")).groupBy("text_id").applyInArrow(gather, "ids binary")


class _Counter:
    """The n-grams of one length that a task has seen: keys not yet sorted, and a filter."""

    def __init__(self, packing: Packing, range_bits: int, limit: int):
        self.packing, self.range_bits, self.limit = packing, range_bits, limit
        self.held, self.size, self.filter = [], 0, None

    def add(self, columns: list[np.ndarray]) -> None:
        self.held.append(self.packing.permute(self.packing.pack(columns)))
        self.size += len(columns[0])

    def settle(self) -> None:
        if self.held:
            new = QuotientFilter.count(self.packing, [np.concatenate(limbs) for limbs in zip(*self.held)])
            self.filter = new if self.filter is None else QuotientFilter.merge([self.filter, new])
            self.held, self.size = [], 0

    def rows(self, last: bool):
        """Hands the filter on, cut at ranges of quotients, when it is full or the task ends."""
        if self.size >= self.limit or last:
            self.settle()
            if self.filter is not None and (last or len(self.filter) >= self.limit):
                for at, part in self.filter.ranges(self.range_bits):
                    yield pa.RecordBatch.from_arrays([pa.array([self.packing.n], pa.int32()), pa.array([at]), pa.array([part.to_bytes()], pa.binary())], ["words", "range", "filter"])
                self.filter = None


def _merge(table: pa.Table, least: int) -> pa.Table:
    whole = QuotientFilter.merge([QuotientFilter.from_bytes(blob.as_py()) for blob in table["filter"]])
    columns, first, counts = whole.at_least(least)
    flat = np.stack(columns, 1).reshape(-1) if len(counts) else np.zeros(0, np.int64)
    grams = pa.ListArray.from_arrays(pa.array((np.arange(len(counts) + 1) * whole.packing.n).astype(np.int32)), pa.array(flat.astype(np.int32)))
    return pa.table({"gram": grams, "first": pa.array(first.view(np.int64)), "n": pa.array(counts)})


def _frequent(streams: DataFrame, lengths: list[int], bits: int, range_bits: int, least: int, pairs=None) -> DataFrame:
    """(gram array<int>, first long, n long) of the n-grams of these lengths that occur ``least`` times or more. ``pairs`` is the shared
    bitmap of frequent pairs and its number of leading bits, for lengths above two."""
    limit, step = HELD, max(1, HELD // 4)

    def count(batches):
        counters = [_Counter(Packing(n, bits), range_bits, limit) for n in lengths]
        two = Packing(2, bits)
        known = np.frombuffer(pairs[0].value, np.uint8) if pairs else None
        for batch in batches:
            for blob in batch.column(0):
                ids = np.frombuffer(blob.as_py(), np.int32)
                for begin in range(0, max(len(ids) - 1, 0), step):  # a long text is cut; its cuts overlap by what an n-gram needs
                    part = ids[begin : begin + step + LONGEST - 1]
                    own = min(step, len(part))
                    near = (part[:-1] != STOP) & (part[1:] != STOP)
                    if pairs is not None:
                        at = np.flatnonzero(near)
                        cell = two.permute(two.pack([part[at], part[at + 1]]))[0] >> np.uint64(two.widths[0] - pairs[1])
                        near[at] = (known[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    run, starts = near, 2
                    for counter in counters:
                        while starts < counter.packing.n:
                            run = run[:-1] & near[starts - 1 :]
                            starts += 1
                        at = np.flatnonzero(run[:own])
                        counter.add([part[at + k] for k in range(counter.packing.n)])
                        yield from counter.rows(False)
        for counter in counters:
            yield from counter.rows(True)

    filters = streams.mapInArrow(count, "words int, range long, filter binary")
    return filters.groupBy("words", "range").applyInArrow(lambda table: _merge(table, least), "gram array<int>, first long, n long")


def _pair_bitmap(pairs: DataFrame, bits: int):
    """The bitmap of the frequent pairs by the leading bits of their permuted form, shared with all tasks."""
    width = 2 * bits
    lead = min(width, MOST_PAIR_BITS, max(15, int(pairs.count()).bit_length() + PAIR_BITS))
    cells = pairs.select((F.shiftrightunsigned("first", width - lead) if width > lead else F.col("first")).alias("cell"))
    cells = cells.select((F.col("cell") / BUCKET).cast("long").alias("bucket"), (F.col("cell") % BUCKET).alias("bit"))
    bitmap = np.zeros(max(1, (1 << lead) // 8), np.uint8)
    for row in cells.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():  # 128 MB at most
        part = np.frombuffer(row["bits"], np.uint8)[: len(bitmap)]
        bitmap[row["bucket"] * BUCKET // 8 : row["bucket"] * BUCKET // 8 + len(part)] = part
    return pairs.sparkSession.sparkContext.broadcast(bitmap.tobytes()), lead


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, totals and phrases of ``docs`` (text, lang, ...): (id, lang, word, n) of words with ``least`` occurrences or more, (lang, total) with all
    occurrences of all words, and (gram, n) with the ids of each phrase of 1 to 5 words that occurs as often."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter(F.col("word").isNull() | (F.col("n") >= least)), "word-counts")
    totals = counts.filter(F.col("word").isNull() & (F.col("n") > 0)).select("lang", F.col("n").alias("total"))
    words = stored(number_rows(counts.filter(F.col("word").isNotNull()), ["lang", "word"], "id", F.lit(-1)), "words")
    ones = words.select(F.array(F.col("id").cast("int")).alias("gram"), "n")
    size, occurrences = words.agg(F.max("id"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size is None:
        return words, totals, ones
    bits = max(1, int(size).bit_length())
    streams = stored(_streams(texts, words), "streams")

    def range_bits(lengths: int) -> int:
        return max(LEAST_RANGE_BITS, (occurrences * lengths // RANGE_GRAMS).bit_length())

    pairs = stored(_frequent(streams, [2], bits, range_bits(1), least), "pairs")
    more = stored(_frequent(streams, list(range(3, LONGEST + 1)), bits, range_bits(LONGEST - 2), least, _pair_bitmap(pairs, bits)), "phrases")
    return words, totals, ones.unionByName(pairs.select("gram", "n")).unionByName(more.select("gram", "n"))


def _cut_at(k: Column, n: Column) -> tuple[Column, Column]:
    return F.slice("gram", F.lit(1), k), F.slice("gram", k + 1, n - k)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from ``docs`` (text, lang, ...): the ``top`` phrases of each language.

    A-Z are lower-cased; ``.,;:!?`` and line ends part pieces, blanks and tabs part words. A phrase of 2 to 5 words with a >= ``least`` occurrences inside
    pieces is scored by its worst cut into l and r occurrences, floor(1000 * a * n / (l * r)) with n the words of the language (of equal scores the
    cut after fewest words). Phrases inside a longer one that occurs as often are left out: the frequency of a part is never below that of the whole, so
    only the parts one word shorter need a look. Order is by score and a, downwards, then phrase by UTF-8 bytes.
    A null text is empty, a null language "und"; empty texts and tables give no rows; repeated rows count as often as they occur; other columns are ignored.
    """
    words, totals, phrases = frequent_phrases(docs, least)
    counts = stored(phrases, "gram-counts")
    long_ = counts.filter(F.size("gram") > 1)
    parts = counts.filter(F.size("gram") > 2).select(F.col("n").alias("whole"), F.explode(F.array(F.expr("slice(gram, 1, size(gram) - 1)"), F.expr("slice(gram, 2, size(gram) - 1)"))).alias("gram"))
    kept = long_.join(parts.groupBy("gram").agg(F.max("whole").alias("whole")), "gram", "left").filter(F.col("whole").isNull() | (F.col("whole") < F.col("n")))
    cuts = kept.select("gram", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    left, right = _cut_at(F.col("k"), F.size("gram"))
    cuts = cuts.select("gram", "a", "k", left.alias("left"), right.alias("right"))
    cuts = cuts.join(counts.select(F.col("gram").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("gram").alias("right"), F.col("n").alias("r")), "right")
    names = words.select(F.col("id").cast("int").alias("word_id"), "lang", "word")
    language = names.select(F.col("word_id").alias("first_id"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("first_id", F.element_at("gram", 1)).join(language, "first_id")
    wide = "cast({} as decimal(38, 0))"
    score = F.expr(f"(cast(1000 as decimal(38, 0)) * {wide.format('a')} * {wide.format('total')}) div ({wide.format('l')} * {wide.format('r')})")
    worst = cuts.withColumn("score", score).groupBy("gram", "lang", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = worst.select("gram", F.posexplode("gram").alias("at", "word_id")).join(names.select("word_id", "word"), "word_id").groupBy("gram").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    rows = worst.join(spelled, "gram").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may hold most phrases: its rows are cut to the top in parts first
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
