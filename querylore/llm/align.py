"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

A text's tokens are rows of a token-byte matrix, one for each tokenizer, in compressed sparse rows (``Csr``). Gustavson's row products of one with
the transpose of the other give every pair of tokens that share bytes, and how many. Byte offsets where tokens of both end cut the tokens into
groups; the product of the two token-group matrices gives the pairs that share a group. All texts of a batch are one block-diagonal matrix.

Link counts of the corpus are sums over distinct id pairs of each text. They are joined back to the texts as shared tables of at most
``SHARED_PAIRS`` pairs: one as long as there are no more, else one slice of the pairs after the other, so no occurrence is ever shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querylore.llm.arrays import _BYTE, pieces, span_hashes
from querylore.llm.bpe import byte_letters
from querylore.llm.common import stored
from querylore.llm.segments import Known, Pieces, column_texts, ragged, spread_ids

BATCH_BYTES = 1 << 20
KNOWN = 1_000_000
SHARED_PAIRS = 2_000_000  # id pairs that tasks hold at once, two numbers each
PRODUCT = 1 << 21  # partial products that are summed at once
MARK = "▁"  # fixed value: a piece's space


class Csr:
    """A sparse matrix in compressed rows: the columns of row i are ``indices[indptr[i] : indptr[i + 1]]``, all of value ``values``."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, columns: int, values: np.ndarray | None = None):
        self.indptr, self.indices, self.columns = indptr, indices, columns
        self.values = np.ones(len(indices), np.int64) if values is None else values

    @classmethod
    def of_spans(cls, sizes: np.ndarray) -> Csr:
        """Rows that cover the columns one after the other, ``sizes[i]`` of them for row i."""
        indptr = np.concatenate([[0], np.cumsum(sizes)])
        return cls(indptr, np.arange(indptr[-1]), int(indptr[-1]))

    @classmethod
    def of_owners(cls, owners: np.ndarray, columns: int) -> Csr:
        """One column in each row."""
        return cls(np.arange(len(owners) + 1), owners, columns)

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transpose(self) -> Csr:
        """By counting the entries of each column."""
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, row[order], self.rows, self.values[order])

    def products(self, other: Csr):
        """Row products of Gustavson in blocks: (first row, Csr of the block's rows of self times other). Row i of the product is the sum of the rows k of
        ``other`` that row i names; a block has about ``PRODUCT`` terms, or one row."""
        width = np.diff(other.indptr)
        terms = np.concatenate([[0], np.cumsum(width[self.indices])])[self.indptr]
        begin = 0
        while begin < self.rows:
            end = max(begin + 1, int(np.searchsorted(terms, terms[begin] + PRODUCT, "right")) - 1)
            at = slice(self.indptr[begin], self.indptr[end])
            k = self.indices[at]
            columns = ragged(other.indices, other.indptr[k], width[k])
            values = ragged(other.values, other.indptr[k], width[k]) * np.repeat(self.values[at], width[k])
            row = np.repeat(np.repeat(np.arange(end - begin), np.diff(self.indptr[begin : end + 1])), width[k])
            key = row * other.columns + columns
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, values = key[order], values[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            sums = np.add.reduceat(values, new) if len(new) else values
            indptr = np.concatenate([[0], np.cumsum(np.bincount(key[new] // other.columns, minlength=end - begin))]) if len(key) else np.zeros(end - begin + 1, np.int64)
            yield begin, Csr(indptr, key[new] % max(1, other.columns), other.columns, sums)
            begin = end


class _Tokens:
    """The bytes of each token of a vocabulary in one table."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.table = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.table, self.begins[ids], self.sizes[ids])


class _ByteLevel:
    """Tokenizer A: ids of the public library, piece by piece; special strings in texts are plain text."""

    def __init__(self, text: str):
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        vocabulary = json.loads(text)["model"]["vocab"]
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.tokens, self.known = _Tokens(tokens), Known(KNOWN)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = Pieces([" " + t for t in texts], spaced=True)
        hashes, at, number = cut.distinct()

        def new_ids(new):
            words = cut.strings(at[new])
            found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return _flat(found)

        return spread_ids(*self.known.get(hashes, new_ids), number, cut.first)


class _SentencePieces:
    """Tokenizer B: ids of the public library for stretches of blanks and what follows up to the next blank. No piece has a blank after another
    character, so none reaches over a stretch's end; a vocabulary with such a piece is asked for whole texts."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = self.processor.id_to_piece(list(range(self.processor.vocab_size())))
        self.whole = any(MARK in name.lstrip(MARK) for name in names)
        tokens = [bytes([int(name[3:5], 16)]) if self.processor.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
        self.tokens, self.known = _Tokens(tokens), Known(KNOWN)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            return _flat(self.processor.encode(texts, num_threads=1))
        blobs = [b" " + t.encode() for t in texts]
        data = np.frombuffer(b"".join(blobs), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[bounds[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes, at, number = np.unique(span_hashes(_BYTE[data], starts, ends), return_index=True, return_inverse=True)

        def new_ids(new):  # the library adds the first blank itself
            whole, own = data.tobytes(), at[new]
            return _flat(self.processor.encode([whole[a + 1 : b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist())], num_threads=1) if len(own) else [])

        return spread_ids(*self.known.get(hashes, self._not_empty(new_ids, at, starts, ends)), number, np.searchsorted(starts, bounds))

    def _not_empty(self, new_ids, at, starts, ends):
        """A lone blank at the end of a text is one piece, but as a text of its own the library gives it none."""
        lone = self.processor.piece_to_id(MARK)

        def ids(new):
            flat, bounds = new_ids(new)
            empty = np.flatnonzero((np.diff(bounds) == 0) & (ends[at[new]] > starts[at[new]]))
            counts = np.diff(bounds)
            counts[empty] = 1
            return np.insert(flat, bounds[empty], lone), np.concatenate([[0], np.cumsum(counts)])

        return ids


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    return np.fromiter(itertools.chain.from_iterable(found), np.int64, bounds[-1]), bounds


class Alignment:
    """Tokens of both tokenizers over the same bytes, for the texts of a batch that both keep byte by byte; ``rows`` are these texts' numbers."""

    def __init__(self, texts: list[str], a, b):
        (a_ids, a_first), (b_ids, b_first) = a.encode(texts), b.encode(texts)
        blobs = [b" " + t.encode() for t in texts]
        sizes = np.array([len(x) if len(x) > 1 else -1 for x in blobs], np.int64)  # an empty text has no tokens
        sums = [np.add.reduceat(np.append(t.tokens.sizes[ids], 0), first[:-1]) if len(texts) else sizes for t, ids, first in ((a, a_ids, a_first), (b, b_ids, b_first))]
        rows = np.flatnonzero((sums[0] == sizes) & (sums[1] == sizes))
        a_kept, b_kept = (_rows_of(ids, first, rows) for ids, first in ((a_ids, a_first), (b_ids, b_first)))
        data = np.frombuffer(b"".join(blobs[r] for r in rows), np.uint8)
        wrong = (a.tokens.bytes_of(a_kept[0]) != data) | (b.tokens.bytes_of(b_kept[0]) != data)
        if wrong.any():
            ends = np.cumsum(sizes[rows])
            right = np.ones(len(rows), bool)
            right[np.searchsorted(ends, np.flatnonzero(wrong), "right")] = False
            rows = rows[right]
            a_kept, b_kept = (_rows_of(ids, first, rows) for ids, first in ((a_ids, a_first), (b_ids, b_first)))
        self.rows = rows
        (self.a, self.a_first), (self.b, self.b_first) = a_kept, b_kept
        self.a_bytes, self.b_bytes = Csr.of_spans(a.tokens.sizes[self.a]), Csr.of_spans(b.tokens.sizes[self.b])
        a_ends, b_ends = self.a_bytes.indptr[1:], self.b_bytes.indptr[1:]  # both ascending
        ends = a_ends[b_ends[np.searchsorted(b_ends, a_ends)] == a_ends] if len(rows) else a_ends
        self.a_group, self.b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        self.groups = len(ends)

    def links(self):
        """(numbers of A tokens, numbers of B tokens) of the pairs that share bytes, in order of A, in blocks."""
        for begin, block in self.a_bytes.products(self.b_bytes.transpose()):
            yield np.repeat(np.arange(begin, begin + block.rows), np.diff(block.indptr)), block.indices

    def group_links(self):
        """The same for the pairs that share a group."""
        a, b = Csr.of_owners(self.a_group, self.groups), Csr.of_owners(self.b_group, self.groups)
        for begin, block in a.products(b.transpose()):
            yield np.repeat(np.arange(begin, begin + block.rows), np.diff(block.indptr)), block.indices

    def group_texts(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        if not len(self.rows):
            return pa.array([], pa.string())
        place = np.concatenate([self.a_group * 2, self.b_group * 2 + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        mark = np.zeros(len(place), np.int64)  # what follows a token: nothing, or , | ;
        step = np.diff(place)
        mark[:-1] = np.where(step == 0, 1, np.where(place[:-1] // 2 == place[1:] // 2, 2, 3))
        first = self.a_first + self.b_first
        mark[first[1:] - 1] = 0
        ids = pa.array(np.concatenate([self.a, self.b])[order]).cast(pa.string())
        tokens = pc.binary_join_element_wise(ids, pa.array(["", ",", "|", ";"]).take(pa.array(mark)), "")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), tokens), "")


def _rows_of(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)[rows]
    return ragged(ids, first[rows], sizes).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


_worker: dict = {}


def _tools(key: str, a, b):
    if _worker.get("key") != key:
        _worker.update(key=key, a=_ByteLevel(a.value), b=_SentencePieces(b.value))
    return _worker["a"], _worker["b"]


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, file_a: str, file_b: str, shared_group: bool = False, texts: bool = True) -> DataFrame:
    """``docs`` (text, ...) with the columns ``ALIGNED`` in place of ``text``; other columns as they are, but for old ones of these names.

    ``file_a`` is a byte-level vocabulary of the tokenizers library, given a blank and the text; ``file_b`` a model of the sentencepiece library,
    given the text, which gets its blank there. ``groups`` lists the ids by group (null without ``texts``: it is several times the text). ``pairs`` are the distinct linked
    id pairs, A * 2^32 + B, and ``times`` how many links each has: tokens that share bytes, or with ``shared_group`` a group. Null, empty and blank
    texts: null and empty ones, and texts whose tokens of either side do not spell the blank and the text, have zeros, an empty
    ``groups_sha256`` and no pairs; blank ones are texts like others. Repeated rows are aligned like others; an empty table gives an empty table.
    """
    with open(file_a, encoding="utf-8") as a, open(file_b, "rb") as b:
        own = a.read(), b.read()
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(v) for v in own]
    key = f"{context.applicationId}-{hash(own)}"
    names = [f.split(" ")[0] for f in ALIGNED.split(", ")]
    rest = docs.drop(*names)
    text_at = rest.columns.index("text")
    others = [c for c in rest.columns if c != "text"]
    others_at = [rest.columns.index(c) for c in others]

    def run(batches):
        tools = _tools(key, *sent)
        for batch in pieces(batches, "text", BATCH_BYTES):
            found = Alignment(column_texts(batch.column(text_at)), *tools)
            rows, n = found.rows, batch.num_rows
            columns = [np.zeros(n, np.int64) for _ in range(4)]
            columns[0][rows], columns[1][rows] = np.diff(found.a_first), np.diff(found.b_first)
            ends = found.a_first[1:] - 1
            columns[2][rows] = np.diff(np.concatenate([[0], found.a_group[ends] + 1])) if len(rows) else 0
            blocks = list(found.group_links() if shared_group else found.links())
            at_a = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in blocks]])
            pair = (found.a[at_a] << 32) | found.b[np.concatenate([np.zeros(0, np.int64), *[y for _, y in blocks]])]
            row = np.searchsorted(found.a_first, at_a, "right") - 1
            columns[3][rows] = np.bincount(row, minlength=len(rows))
            order = np.lexsort([pair, row])
            row, pair = row[order], pair[order]
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(pair))).astype(np.int32)
            per_row = np.zeros(n, np.int64)
            per_row[rows] = np.bincount(row[new], minlength=len(rows))
            bounds = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
            spelled, digests = [None] * n, [""] * n
            for r, text in zip(rows.tolist(), found.group_texts()):
                digests[r] = hashlib.sha256(text.as_buffer()).hexdigest()
                spelled[r] = text.as_py() if texts else None
            if texts:
                spelled = [s or "" for s in spelled]
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (pair[new], times)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in others_at] + [pa.array(c) for c in columns] + [pa.array(spelled, pa.string()), pa.array(digests), *lists], [*others, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "text")
    return rest.mapInArrow(run, f"{schema}, {ALIGNED}" if others else ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best) for the corpus: how many links hold each id pair, and whether no A id has more with this B id."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    each = stored(each.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n"), "pairs")
    most = each.groupBy("b").agg(F.max("n").alias("most"))
    return each.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned_documents(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs`` (doc_id, text, ...).

    n_best counts the links whose pair is the corpus's most frequent one of its B id, ties included; count_sum adds up the pairs' corpus counts over
    the links. Rows without a doc_id and rows that repeat one have rows of their own and count in the corpus. Other columns are ignored.
    """
    aligned = align(docs.select("doc_id", "text"), file_a, file_b, texts=False).drop("groups").withColumn("row", F.monotonically_increasing_id())
    aligned = stored(aligned, "aligned")
    counts = stored(link_counts(aligned).select("pair", "n", F.col("best").cast("long").alias("best")), "link-counts")
    slices = max(1, -(-counts.count() // SHARED_PAIRS))
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def part(i: int) -> DataFrame:
        each = aligned.select(*own, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(*own, F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        some = counts
        if slices > 1:
            slice_ = F.pmod(F.xxhash64("pair"), F.lit(slices)) == i
            each, some = each.filter(slice_), counts.filter(slice_)
        each = each.join(F.broadcast(some), "pair")
        return each.groupBy(*own).agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    zero = F.lit(0).cast("long")
    parts = reduce(DataFrame.unionByName, [part(i) for i in range(slices)], aligned.filter("n_links = 0").select(*own, zero.alias("n_best"), zero.alias("count_sum")))
    if slices > 1:
        parts = parts.groupBy(*own).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return parts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
