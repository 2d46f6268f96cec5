"""Scoring of a block of questions against a stream of chunk batches, inside a task.

Spark partitions the chunks and merges the results; these functions see one block of questions and one batch of chunks
at a time and keep only the best rows of each question. No (question, chunk) pair leaves a task unless it is among them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 4_000_000  # score matrix cells held at once
PAIRS = 500_000  # pairs scored exactly at once
ASKED = 1_000  # questions whose best are kept together
NEAR = 250_000  # products of vectors held at once: they stay near the core
SLACK = 1e-9  # wider than the rounding difference between a matrix product and a plain sum


def vectors(column) -> np.ndarray:
    """A list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (row number, value) pairs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def plain_dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of paired rows, summed in order of dimension, so that equal vectors get equal scores everywhere."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def plain_scores(chunks: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """The same sums for every chunk and question."""
    total = np.zeros((len(chunks), len(questions)))
    for d in range(chunks.shape[1]):
        total += chunks[:, d, None] * questions[None, :, d]
    return total


class Best:
    """The k best (score, then smallest id) of each question so far."""

    def __init__(self, questions: int, k: int):
        self.questions, self.k = questions, k
        self.question = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.ident = np.empty(0, np.int64)
        self.extra = np.empty(0, object)
        self.floor = np.full(questions, -np.inf)

    def add(self, question, score, ident, extra) -> None:
        q = np.concatenate([self.question, question])
        s = np.concatenate([self.score, score])
        i = np.concatenate([self.ident, ident])
        e = np.concatenate([self.extra, extra])
        order = np.lexsort((i, -s, q))
        q = q[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.k
        order = order[keep]
        self.question, self.score, self.ident, self.extra = q[keep], s[order], i[order], e[order]
        full = np.bincount(self.question, minlength=self.questions) >= self.k
        lowest = np.full(self.questions, np.inf)
        np.minimum.at(lowest, self.question, self.score)
        self.floor = np.where(full, lowest, -np.inf)


def _extra(batch, carry: str | None) -> np.ndarray:
    return batch.column(carry).to_numpy(zero_copy_only=False).astype(object) if carry else np.full(batch.num_rows, None, object)


def _result(questions: pa.Table, keys: list[str], best: Best, carry: str | None) -> pa.RecordBatch:
    columns = [questions.column(k).combine_chunks().take(pa.array(best.question)) for k in keys]
    columns += [pa.array(best.ident, pa.int64()), pa.array(best.score, pa.float64())]
    names = [*keys, "chunk_id", "score"]
    if carry:
        columns.append(pa.array(best.extra, pa.string()))
        names.append(carry)
    return pa.RecordBatch.from_arrays(columns, names=names)


def _matrix(column) -> np.ndarray:
    """A list column as a matrix of its own type if that is float and no product or sum of its values can leave the type, else of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    far = flat.dtype != np.float32 or not (np.isfinite(flat).all() and (len(flat) == 0 or np.abs(flat).max() < 1e12))
    return flat.astype(np.float64 if far else np.float32).reshape(len(column), -1)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))


class _Part:
    """Some questions, compared with the same chunks, and their best so far."""

    def __init__(self, asked: np.ndarray, value, wanted: np.ndarray, k: int):
        self.asked, self.value, self.wanted, self.k = asked, value, wanted[asked], k
        self.lengths, self.best = _lengths(self.wanted), Best(len(asked), k)

    def look(self, have: np.ndarray, rows: np.ndarray, ident: np.ndarray, extra: np.ndarray) -> None:
        """A matrix product finds the candidates among the rows, the plain sum decides among them: exact, ties included."""
        step, waiting = max(1, NEAR // len(self.asked)), []
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            own = have[part]
            wanted = self.wanted if self.wanted.dtype == own.dtype else self.wanted.astype(np.float64)
            scores = own @ wanted.T
            # by how much a product can differ from the plain sum, whatever the order of its terms
            unit = np.finfo(scores.dtype).eps
            slack = SLACK + 2 * (have.shape[1] + 2) * unit * self.lengths * _lengths(own).max()

            def reached(lowest):
                return np.flatnonzero(scores >= np.nextafter((np.maximum(lowest, self.best.floor) - slack).astype(scores.dtype), scores.dtype.type(-np.inf)))

            near = reached(-np.inf) if np.isfinite(self.best.floor).all() else None
            if len(part) > self.k and (near is None or len(near) > 4 * self.k * len(self.asked)):
                near = reached(np.partition(scores, len(part) - self.k, axis=0)[len(part) - self.k].astype(np.float64))
            elif near is None:
                near = reached(-np.inf)
            waiting.append((part[near // len(self.asked)], near % len(self.asked)))
            # few candidates wait for others, as each addition sorts all that is best so far
            if sum(len(r) for r, _ in waiting) > self.k * len(self.asked) or start == 0 or start + step >= len(rows):
                row, column = (np.concatenate(x) for x in zip(*waiting))
                waiting = []
                for s in range(0, len(row), PAIRS):
                    r, c = row[s:s + PAIRS], column[s:s + PAIRS]
                    self.best.add(c, plain_dot(have[r].astype(np.float64), self.wanted[c].astype(np.float64)), ident[r], extra[r])


def _parts(questions: pa.Table, k: int, by: str | None, order: np.ndarray | None = None) -> list[_Part]:
    """The questions in parts of ``ASKED``, each of one value of ``by``."""
    wanted = _matrix(questions.column("embedding"))
    order = np.arange(len(wanted)) if order is None else order
    groups = {None: order}
    if by:
        values = np.asarray(questions.column(by).to_pylist(), object)[order]
        groups = {v: order[values == v] for v in set(values)}
    return [_Part(own[at:at + ASKED], value, wanted, k) for value, own in groups.items() for at in range(0, len(own), ASKED)]


def _of_value(batch: pa.RecordBatch, by: str | None, parts: list[_Part]) -> dict:
    """The rows of a batch for each value the parts ask for."""
    if not by:
        return {None: np.arange(batch.num_rows)}
    own = np.asarray(batch.column(by).to_pylist(), object)
    return {v: np.flatnonzero(own == v) for v in {p.value for p in parts}}


def _results(questions: pa.Table, keys: list[str], parts: list[_Part], carry: str | None) -> Iterator[pa.RecordBatch]:
    for part in parts:
        part.best.question = part.asked[part.best.question]
        yield _result(questions, keys, part.best, carry)


def vector_top_k(questions: pa.Table, batches: Iterator[pa.RecordBatch], keys: list[str], k: int, by: str | None, carry: str | None) -> Iterator[pa.RecordBatch]:
    """The best chunks of each question by dot product."""
    parts = _parts(questions, k, by)
    for batch in batches:
        if batch.num_rows:
            have, ident, extra = _matrix(batch.column("embedding")), batch.column("chunk_id").to_numpy(), _extra(batch, carry)
            rows = _of_value(batch, by, parts)
            for part in parts:
                part.look(have, rows[part.value], ident, extra)
    yield from _results(questions, keys, parts, carry)


def _vocabulary(questions: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, where each term's questions begin, those questions, and the number of terms of each question."""
    row, value = lists(questions.column("terms"))
    order = np.argsort(value, kind="stable")
    terms, first = np.unique(value[order], return_index=True)
    return terms, np.append(first, len(value)), row[order], np.maximum(np.bincount(row, minlength=questions.num_rows), 1)


def _shares(batch: pa.RecordBatch, terms: np.ndarray, first: np.ndarray, asked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Share of each question's distinct terms that each chunk holds, counted over the pairs that share a term."""
    row, value = lists(batch.column("terms"))
    place = np.minimum(np.searchsorted(terms, value), max(len(terms) - 1, 0))
    known = terms[place] == value if len(terms) else np.zeros(len(value), bool)
    row, place = row[known], place[known]
    counts = first[place + 1] - first[place]
    question = asked[np.repeat(first[place] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    held = np.bincount(np.repeat(row, counts) * len(size) + question, minlength=batch.num_rows * len(size))
    return held.reshape(batch.num_rows, len(size)) / size


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def score_ranges(questions: pa.Table, batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Smallest and largest vector score and keyword share of each question over the batches seen."""
    wanted = vectors(questions.column("embedding"))
    words = _vocabulary(questions)
    low, high = np.full((2, len(wanted)), np.inf), np.full((2, len(wanted)), -np.inf)
    for batch in _slices(batches, len(wanted)):
        both = plain_scores(vectors(batch.column("embedding")), wanted), _shares(batch, *words)
        for n, scores in enumerate(both):
            low[n] = np.minimum(low[n], scores.min(axis=0))
            high[n] = np.maximum(high[n], scores.max(axis=0))
    if np.isfinite(low[0]).any():
        columns = [questions.column(k).combine_chunks() for k in keys] + [pa.array(x) for x in (low[0], high[0], low[1], high[1])]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "vector_low", "vector_high", "keyword_low", "keyword_high"])


def hybrid_top_k(questions: pa.Table, batches: Iterator[pa.RecordBatch], keys: list[str], k: int, w_vector: float, w_keyword: float, carry: str | None) -> Iterator[pa.RecordBatch]:
    """Weighted sum of both scores, each scaled to 0..1 by the ranges in the question rows."""
    wanted = vectors(questions.column("embedding"))
    words = _vocabulary(questions)
    low_v, high_v, low_k, high_k = (questions.column(n).to_numpy() for n in ("vector_low", "vector_high", "keyword_low", "keyword_high"))
    best = Best(len(wanted), k)

    def scaled(scores, low, high):
        span = np.where(high > low, high - low, 1.0)
        return np.where(high > low, (scores - low) / span, 0.0)

    for batch in _slices(batches, len(wanted)):
        score = (w_vector * scaled(plain_scores(vectors(batch.column("embedding")), wanted), low_v, high_v)
                 + w_keyword * scaled(_shares(batch, *words), low_k, high_k))
        _offer(best, score, batch, k, carry)
    yield _result(questions, keys, best, carry)


def asked_terms(words: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with those of their terms, in order, that are among the words."""
    asked = np.sort(words.column("word").to_numpy())
    for batch in batches:
        row, value = lists(batch.column("terms"))
        place = np.minimum(np.searchsorted(asked, value), max(len(asked) - 1, 0))
        known = asked[place] == value if len(asked) else np.zeros(len(value), bool)
        row, value = row[known], value[known]
        order = np.lexsort((value, row))
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[order], pa.int64()))
        yield pa.RecordBatch.from_arrays([kept if name == "terms" else batch.column(name) for name in batch.schema.names], batch.schema.names)


class _Lists:
    """For every term the questions that have it. Within a question terms are placed from rare to common, by how many questions have them."""

    def __init__(self, questions: pa.Table):
        row, value = lists(questions.column("terms"))
        self.terms, number, often = np.unique(value, return_inverse=True, return_counts=True)
        order = np.lexsort((number, often[number], row))
        row, number = row[order], number[order]
        self.sizes = np.bincount(row, minlength=questions.num_rows)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.own = number  # the terms of each question, rare ones first
        place = np.arange(len(row)) - self.begins[row]
        by_term = np.argsort(number, kind="stable")
        self.term, self.question, self.place = number[by_term], row[by_term], place[by_term]

    def telling(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists cut to the terms that can bring in a chunk: one whose share reaches the floor holds at least ``need`` terms of the question, so it
        holds one of all but the ``need - 1`` most common. Bounds of each term's list, and the questions in it."""
        need = np.maximum(1, np.ceil(np.maximum(floor, 0) * self.sizes - SLACK)).astype(np.int64)
        kept = self.place < (self.sizes - need + 1)[self.question]
        return np.concatenate([[0], np.cumsum(np.bincount(self.term[kept], minlength=len(self.terms)))]), self.question[kept]


def _spread(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``at`` the positions bounds[at] .. bounds[at + 1], one after the other, and how many they are."""
    counts = bounds[at + 1] - bounds[at]
    return np.repeat(bounds[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum()), counts


def keyword_top_k(questions: pa.Table, batches: Iterator[pa.RecordBatch], keys: list[str], k: int, carry: str | None) -> Iterator[pa.RecordBatch]:
    """Best chunks by share of question terms alone. Pairs come from the lists of telling terms and are counted in full; a pair
    that shares no term is looked at only while a question has fewer than k chunks that share one."""
    own = _Lists(questions)
    sizes = np.maximum(own.sizes, 1)
    best = Best(questions.num_rows, k)
    for batch in batches:
        row, value = lists(batch.column("terms"))
        place = np.minimum(np.searchsorted(own.terms, value), max(len(own.terms) - 1, 0))
        known = own.terms[place] == value if len(own.terms) else np.zeros(len(value), bool)
        row, place = row[known], place[known]
        begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
        everywhere = np.bincount(own.term, minlength=len(own.terms))
        load = np.concatenate([[0], np.cumsum(everywhere[place])])[begin]  # pairs before each row, at most
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(load, load[start] + CELLS // 4, "right")) - 1)
            here = slice(begin[start], begin[end])
            _add_shares(best, own, sizes, batch.slice(start, end - start), row[here] - start, place[here], k, carry)
            start = end
    yield _result(questions, keys, best, carry)


def _add_shares(best: Best, own: _Lists, sizes: np.ndarray, batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, k: int, carry: str | None) -> None:
    ident, extra, n = batch.column("chunk_id").to_numpy(), _extra(batch, carry), best.questions
    bounds, asked = own.telling(best.floor)
    at, counts = _spread(bounds, place)
    pair = np.unique(np.repeat(row, counts) * n + asked[at])
    has = np.sort(row * max(1, len(own.terms)) + place)
    ends = np.append(own.begins, len(own.own))
    for s in range(0, len(pair), PAIRS):
        chunk, question = pair[s:s + PAIRS] // n, pair[s:s + PAIRS] % n
        at, counts = _spread(ends, question)
        wanted = np.repeat(chunk, counts) * max(1, len(own.terms)) + own.own[at]
        found = np.searchsorted(has, wanted)
        hit = has[np.minimum(found, len(has) - 1)] == wanted
        held = np.bincount(np.repeat(np.arange(len(chunk)), counts)[hit], minlength=len(chunk))
        score = held / sizes[question]
        kept = score >= best.floor[question]
        best.add(question[kept], score[kept], ident[chunk[kept]], extra[chunk[kept]])
    open_ = np.flatnonzero(best.floor <= 0)  # of chunks that share nothing the smallest ids fill up
    if len(open_):
        met = np.bincount(pair % n, minlength=n)[open_] if len(pair) else np.zeros(len(open_), np.int64)
        by_id = np.argsort(ident, kind="stable")
        many = np.minimum(k + met, len(ident))  # so many of the smallest ids have k that share nothing, if there are as many
        for s in range(0, len(open_), max(1, PAIRS // max(1, int(many.max())))):
            part = slice(s, s + max(1, PAIRS // max(1, int(many.max()))))
            question = np.repeat(open_[part], many[part])
            chunk = by_id[np.arange(len(question)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])]
            key = chunk * n + question
            place_ = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            none = pair[place_] != key if len(pair) else np.ones(len(key), bool)
            best.add(question[none], np.zeros(int(none.sum())), ident[chunk[none]], extra[chunk[none]])


def _offer(best: Best, score: np.ndarray, batch: pa.RecordBatch, k: int, carry: str | None) -> None:
    """Many chunks can tie on a keyword share, so of equal scores only the k smallest ids go on."""
    ident, extra = batch.column("chunk_id").to_numpy(), _extra(batch, carry)
    by_id = np.argsort(ident, kind="stable")
    ranked = np.argsort(-score[by_id], axis=0, kind="stable")[:k]
    row = by_id[ranked]
    column = np.broadcast_to(np.arange(score.shape[1]), row.shape)
    keep = score[row, column] >= best.floor[column]
    r, c = row[keep], column[keep]
    best.add(c, score[r, c], ident[r], extra[r])


# --- search by cells ----------------------------------------------------------------------------------------------------

def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance to it."""
    at = np.zeros(len(points), np.int64)
    norms = (centres**2).sum(1)
    step = max(1, CELLS // max(1, len(centres)))
    for start in range(0, len(points), step):
        part = slice(start, start + step)
        at[part] = (norms - 2 * points[part] @ centres.T).argmin(1)
    return at, np.sqrt(((points - centres[at]) ** 2).sum(1))


def bounds_in(cell: int, wanted: np.ndarray, norms: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no vector of the cell can exceed, for each question: the product with the centre and the rest of length ``radius`` at most."""
    product = wanted @ centres[cell]
    return product + norms * radius[cell] + SLACK * (1 + np.abs(product) + norms * radius[cell])


def cell_top_k(questions: pa.Table, batches: Iterator[pa.RecordBatch], keys: list[str], k: int, by: str | None, carry: str | None,
               centres: np.ndarray, radius: np.ndarray, seeds: bool) -> Iterator[pa.RecordBatch]:
    """As ``vector_top_k`` over chunks with their ``cell``. Questions of one seed are compared together. In the first round (``seeds``) they look into
    their ``seed`` cells; in the second into the cells whose bound reaches the ``floor`` of one of them, the k-th score of the first round, or the
    k-th score seen since."""
    seed = questions.column("seed").to_numpy()
    parts = _parts(questions, k, by, np.argsort(seed, kind="stable"))
    floor = None if seeds else questions.column("floor").to_numpy()
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, cell = np.unique(batch.column("cell").to_numpy(), return_inverse=True)
        have, ident, extra = _matrix(batch.column("embedding")), batch.column("chunk_id").to_numpy(), _extra(batch, carry)
        rows = _of_value(batch, by, parts)
        for part in parts:
            if seeds:
                open_ = np.isin(cells, seed[part.asked])
            else:
                least = np.maximum(floor[part.asked], part.best.floor)
                product = centres[cells] @ part.wanted.T.astype(np.float64)
                reach = radius[cells][:, None] * part.lengths
                open_ = (product + reach + SLACK * (1 + np.abs(product) + reach) >= least).any(1)
            own = rows[part.value]
            part.look(have, own[open_[cell[own]]], ident, extra)
    yield from _results(questions, keys, parts, carry)
