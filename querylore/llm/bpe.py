"""Encoding and decoding with a word-level byte-pair vocabulary, through a lexicon of the corpus's frequent words.

One pass counts all words of the corpus. The ``LEXICON`` most frequent are encoded once and compiled into a minimal acyclic
transducer with their ids as outputs (see lexicon.py), which each worker memory-maps. A batch looks up its distinct words in it
all at once; words it does not know are merged exactly, pair by pair, by the vocabulary's ranks. The lexicon changes the
speed, never a result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylore.llm.arrays import pieces
from querylore.llm.common import stored
from querylore.llm.lexicon import Lexicon, compile_lexicon
from querylore.llm.segments import Known, Pieces, column_texts, put_together, split_specials, spread_ids

LEXICON = 50_000
BATCH_BYTES = 1 << 20
KNOWN = 1_000_000  # merged words a worker remembers, in about 30 bytes each
SPAN = 1 << 31  # pairs of ids are kept as one number
LONG_WORD = 256  # bytes; longer words are merged one by one, through a heap
NO_RANK = 1 << 40
GONE = -2  # a symbol that became part of the one before it


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: Latin-1 where printable, else code points from 256 on, in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def normalized(text: str) -> str:
    """Canonical composition and lower case letter by letter (no final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Vocabulary:
    """Ids, merge ranks and special strings of a vocabulary file, and exact merging."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        known = [(i, self.ids[x], self.ids[y], self.ids[x + y]) for i, (x, y) in enumerate(merges) if x in self.ids and y in self.ids and x + y in self.ids]
        keys = np.array([x * SPAN + y for _, x, y, _ in known], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.rank_of = keys[order], np.array([i for i, *_ in known], np.int64)[order]
        self.ranks = {key: (i, z) for (i, _, _, z), key in zip(known, keys.tolist())}
        self.joined = np.zeros(len(merges) + 1, np.int64)
        for i, _, _, z in known:
            self.joined[i] = z
        letters = byte_letters()
        self.inner = np.array([self.ids.get(c, -1) for c in letters], np.int64)
        self.last = np.array([self.ids.get(c + self.suffix, -1) for c in letters], np.int64)
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        top = max([*self.ids.values(), *self.specials.values()])
        self.tokens = [""] * (top + 1)
        for token, i in [*self.ids.items(), *self.specials.items()]:
            self.tokens[i] = token

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and the bounds of each."""
        is_long = np.array([len(w) > LONG_WORD for w in words], bool)
        if not is_long.any():
            return self._merge_together(words)
        flat, bounds = self._merge_together([w for w, l in zip(words, is_long) if not l])
        parts, counts, short = [], np.zeros(len(words), np.int64), 0
        for i, word in enumerate(words):
            if is_long[i]:
                parts.append(self._merge_long(word))
            else:
                parts.append(flat[bounds[short] : bounds[short + 1]])
                short += 1
            counts[i] = len(parts[-1])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word: pairs wait in a heap by rank and place, symbols are a linked list, so a word of n bytes takes n log n steps."""
        raw = np.frombuffer(word, np.uint8)
        symbols = np.append(self.inner[raw[:-1]], self.last[raw[-1]]).tolist()
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], at, found[1]) for at in range(n - 1) if (found := ranks.get(symbols[at] * SPAN + symbols[at + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, at, joined = heapq.heappop(heap)
            right = after[at]
            found = ranks.get(symbols[at] * SPAN + symbols[right]) if symbols[at] != GONE and right < n else None
            if found is None or found[0] != rank:
                continue  # the pair was joined with something else meanwhile
            symbols[at], symbols[right] = joined, GONE
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
                if pair := ranks.get(joined * SPAN + symbols[after[at]]):
                    heapq.heappush(heap, (pair[0], at, pair[1]))
            left = before[at]
            if left >= 0 and (pair := ranks.get(symbols[left] * SPAN + joined)):
                heapq.heappush(heap, (pair[0], left, pair[1]))
        return np.array([s for s in symbols if s >= 0], np.int32)

    def _merge_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words take each step together: the adjacent pair of least rank is joined, leftmost first, until no pair of the word has a rank."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends[sizes > 0] - 1] = self.last[raw[ends[sizes > 0] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        live = np.arange(len(symbols))  # positions that can still change, whole words at a time
        gone = np.zeros(len(symbols), bool)
        while len(live) > 1 and len(self.pairs):
            a, b = live[:-1], live[1:]
            pair = symbols[a] * SPAN + symbols[b]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == pair) & (word[a] == word[b]), self.rank_of[at], NO_RANK)
            own = word[a]
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            least = np.minimum.reduceat(rank, begins)
            spread = np.repeat(least, np.diff(np.append(begins, len(own))))
            hits = np.flatnonzero((rank == spread) & (rank < NO_RANK))
            hits = hits[np.concatenate([[True], own[hits][1:] != own[hits][:-1]])] if len(hits) else hits
            symbols[a[hits]] = self.joined[rank[hits]]
            gone[b[hits]] = True
            open_ = np.zeros(len(words), bool)
            open_[own[hits]] = True
            live = live[~gone[live] & open_[word[live]]]
        kept = ~gone & (symbols >= 0)
        counts = np.bincount(word[kept], minlength=len(words))
        return symbols[kept].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def _counted(batches):
    for batch in pieces(batches, "text", BATCH_BYTES):
        cut = Pieces([normalized(t) for t in column_texts(batch.column(0))], spaced=False)
        _, at, number = cut.distinct()
        yield pa.RecordBatch.from_arrays([pa.array(cut.strings(at), pa.string()), pa.array(np.bincount(number, minlength=len(at)))], ["word", "n"])


def frequent_words(docs: DataFrame, size: int = LEXICON) -> list[str]:
    """At most ``size`` words with most occurrences in all texts: whole levels of like counts, sixteen levels to a doubling.

    Only the number of words of each level and then the chosen words reach the driver. Words that occur once are never chosen.
    """
    counts = docs.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = stored(counts.filter("n > 1").select("word", F.floor(F.log2("n") * 16).cast("int").alias("level")), "word-levels")
    total, least = 0, None
    for row in sorted(kept.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > size:
            break
        least = row["level"]
    return [] if least is None else sorted(r["word"] for r in kept.filter(F.col("level") >= least).select("word").collect())


_worker: dict = {}  # per process: the vocabulary and lexicon in use, and words merged so far


def _tools(key, vocabulary, lexicon) -> tuple[Vocabulary, Lexicon, Known]:
    if _worker.get("key") != key:
        _worker.update(key=key, vocabulary=Vocabulary(vocabulary.value), lexicon=Lexicon(lexicon.value), known=Known(KNOWN))
    return _worker["vocabulary"], _worker["lexicon"], _worker["known"]


def word_ids(words: list[bytes], hashes: np.ndarray, vocabulary: Vocabulary, lexicon: Lexicon, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table of ids, and where the ids of each of the distinct words begin in it and how many they are."""
    ranks = lexicon.ranks(words)
    seen, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
    merged, at, n = known.get(hashes[unseen], lambda new: vocabulary.merge([words[i] for i in unseen[new]]))
    begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    begins[seen], sizes[seen] = lexicon.spans(ranks[seen])
    begins[unseen], sizes[unseen] = at + len(lexicon.ids), n
    return np.concatenate([np.asarray(lexicon.ids, np.int32), merged]), begins, sizes


def encode(docs: DataFrame, vocabulary_file: str, size: int = LEXICON) -> DataFrame:
    """``docs`` (text, ...) with ``ids``, the sub-word ids of the whole text; other columns as they are, an old ``ids`` is replaced.

    A null, empty or blank text has no ids; repeated rows are encoded alike, an empty table gives an empty table. The longest word may be a whole text: a word of n
    bytes takes about n log n steps, and a text is held by one task. Special strings of the vocabulary inside a text become their ids, as in the public library.
    The vocabulary file is read on the driver and sent to the tasks.
    """
    return _encoded(docs, vocabulary_file, size, False)


def round_trip(docs: DataFrame, vocabulary_file: str, size: int = LEXICON) -> DataFrame:
    """``docs`` (text, ...) with ``ids`` and ``decoded`` (old columns of these names are replaced) in place of the text: the rows that ``decode`` makes of those of
    ``encode``. Both are done in one pass, as two passes in a row would hold two Python workers with their tables for each task."""
    return _encoded(docs, vocabulary_file, size, True)


def _encoded(docs: DataFrame, vocabulary_file: str, size: int, decoded: bool) -> DataFrame:
    with open(vocabulary_file, encoding="utf-8") as file:
        text = file.read()
    vocabulary = Vocabulary(text)
    words = [w.encode() for w in frequent_words(docs, size)]
    ids, bounds = vocabulary.merge(words)
    blob = compile_lexicon([(w, ids[a:b]) for w, a, b in zip(words, bounds, bounds[1:])])
    context = docs.sparkSession.sparkContext
    sent_vocabulary, sent_lexicon, key = context.broadcast(text), context.broadcast(blob), f"{context.applicationId}-{hash(blob)}-{hash(text)}"
    rest = docs.drop("ids", *["decoded"] * decoded)
    text_at = rest.columns.index("text")
    kept = [i for i, name in enumerate(rest.columns) if not (decoded and name == "text")]
    names = [rest.columns[i] for i in kept]

    def run(batches):
        vocabulary, lexicon, known = _tools(key, sent_vocabulary, sent_lexicon)
        table = pa.array(vocabulary.tokens, pa.string()) if decoded else None
        for batch in pieces(batches, "text", BATCH_BYTES):
            segments, parts = split_specials(column_texts(batch.column(text_at)), vocabulary.specials)
            cut = Pieces([normalized(s) for s in segments], spaced=False)
            hashes, at, number = cut.distinct()
            words = [w.encode() for w in cut.strings(at)]
            flat, bounds = spread_ids(*word_ids(words, hashes, vocabulary, lexicon, known), number, cut.first)
            flat, bounds = put_together(flat, bounds, parts)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
            out = pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [lists], [*names, "ids"])
            yield from _with_decoded(out, len(names), table) if decoded else [out]

    schema = "".join(f"`{rest.columns[i]}` {rest.schema[i].dataType.simpleString()}, " for i in kept)
    return rest.mapInArrow(run, f"{schema}ids array<int>{', decoded string' * decoded}")


def _with_decoded(batch: pa.RecordBatch, ids_at: int, table: pa.Array):
    """The rows of a batch with the text of their ids; ``table`` has the tokens in order of their ids."""
    for at in range(0, batch.num_rows, 256):  # decoded texts are several times as long as ids
        part = batch.slice(at, 256)
        column = part.column(ids_at)
        column = pc.fill_null(column, []) if column.null_count else column
        flat, bounds = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        known = (flat >= 0) & (flat < len(table))
        kept = np.concatenate([[0], np.cumsum(known)])
        texts = pa.ListArray.from_arrays(pa.array(kept[bounds - bounds[0]].astype(np.int32)), table.take(pa.array(flat[known])))
        yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(texts, " ")], [*part.schema.names, "decoded"])


def decode(encoded: DataFrame, vocabulary_file: str) -> DataFrame:
    """``encoded`` (ids, ...) with ``decoded`` (leave texts out before: all columns travel along): the tokens of the ids joined by one space, which is what the public library gives for a
    vocabulary without a decoder. Ids outside the vocabulary are left out; null or empty ids give an empty text. Long texts are decoded whole, repeated
    rows alike; an empty table gives an empty table."""
    with open(vocabulary_file, encoding="utf-8") as file:
        tokens = Vocabulary(file.read()).tokens
    sent = encoded.sparkSession.sparkContext.broadcast(tokens)
    rest = encoded.drop("decoded")
    ids_at = rest.columns.index("ids")

    def run(batches):
        table = pa.array(sent.value, pa.string())
        for batch in batches:
            yield from _with_decoded(batch, ids_at, table)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, decoded string")
