"""Cutting texts into the pieces that two public sub-word vocabularies merge inside of, on whole batches with numpy.

The rules are those of the vocabularies' published patterns (fixed values):
    spaced:  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    words:   's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+      (white space between pieces is dropped)
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from querylore.llm.arrays import mix, span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
LAST_PLANE = 0x40000
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of every code point; made once per process."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
        table = np.zeros(0x110000, np.uint8)  # no letter, number or space has a code point beyond the third plane
        table[:LAST_PLANE] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LAST_PLANE)), np.uint8, LAST_PLANE)
        table[[9, 10, 11, 12, 13, 0x85]] = SPACE
        _classes = table
    return _classes


class Pieces:
    """Pieces of several texts: spans over ``joined``, hashes, and ``first[i] : first[i + 1]`` as the pieces of text i."""

    def __init__(self, texts: list[str], spaced: bool):
        self.joined = "".join(texts)
        codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        n = len(codes)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        kind = char_classes()[codes]
        edge = np.zeros(n + 3, bool)  # a text begins here
        edge[bounds] = True
        cut = edge[:n].copy()
        if n:
            cut[1:] |= kind[1:] != kind[:-1]
            if not spaced:
                cut |= kind == NUMBER
            self._contractions(codes, kind, edge, cut, spaced)
            if spaced:
                self._spaces(codes, kind, edge, cut)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        if not spaced:
            words = kind[starts] != SPACE
            starts, ends = starts[words], ends[words]
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, bounds)
        self.hashes = span_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), starts, ends)

    @staticmethod
    def _contractions(codes, kind, edge, cut, spaced):
        """An apostrophe that begins a match takes s, t, re, ve, m, ll or d with it."""
        n = len(codes)
        at = np.flatnonzero((codes == 39) & cut)
        at = at[at + 1 < n]
        at = at[(kind[at + 1] == LETTER) & ~edge[at + 1]]
        if spaced:
            at = at[edge[at] | (codes[np.maximum(at - 1, 0)] != 32)]
        one = codes[at + 1]
        two = np.where((at + 2 < n) & ~edge[at + 2], codes[np.minimum(at + 2, n - 1)], 0)
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(c) for c in "stmd"])
        for hits, size in ((at[short], 1), (at[long_], 2)):
            cut[hits + 1] = False
            after = hits + 1 + size
            cut[after[after < n]] = True

    @staticmethod
    def _spaces(codes, kind, edge, cut):
        """Of white space before a word, the last character stands alone, or joins the word if it is a plain space."""
        n = len(codes)
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
        cut[last] = True
        cut[last[codes[last] == 32] + 1] = False

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes in ascending order, an occurrence of each, and the number of each occurrence's hash among them."""
        return np.unique(self.hashes, return_index=True, return_inverse=True)

    def strings(self, at: np.ndarray) -> list[str]:
        """The texts of these occurrences."""
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


class Known:
    """Ids of pieces by hash, in flat arrays: what a worker has encoded already, up to ``limit`` pieces; then it starts afresh."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begins = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        inside = np.minimum(at, max(0, len(self.hashes) - 1))
        return np.where(self.hashes[inside] == hashes, inside, -1) if len(self.hashes) else np.full(len(hashes), -1)

    def get(self, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids and, for each of the distinct, ascending hashes, where its ids begin and how many they are. ``encode`` is given
        the positions of unknown hashes and returns their ids, one piece after the other, and the bounds of each."""
        new = self._find(hashes) < 0
        if len(self.hashes) + new.sum() > self.limit:
            self.clear()
            new[:] = True
        if new.any():
            flat, bounds = encode(np.flatnonzero(new))
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, at, hashes[new])
            self.begins = np.insert(self.begins, at, bounds[:-1] + len(self.ids))
            self.sizes = np.insert(self.sizes, at, np.diff(bounds).astype(np.int32))
            self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        at = self._find(hashes)
        return self.ids, self.begins[at], self.sizes[at].astype(np.int64)


def ragged(table: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """table[begins[i] : begins[i] + sizes[i]] for each i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)]


def spread_ids(table: np.ndarray, begins: np.ndarray, sizes: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all occurrences in order, and the bounds of each text's ids; piece k has table[begins[k] : begins[k] + sizes[k]]."""
    counts = sizes[number]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ragged(table, begins[number], counts), ends[first]


def split_specials(texts: list[str], specials: dict[str, int]) -> tuple[list[str], list[list[tuple[int, int | None]]]]:
    """Texts cut at special strings: plain segments, and for each text its parts as (segment, None) or (-1, special id)."""
    segments: list[str] = []
    parts: list[list[tuple[int, int | None]]] = []
    # the first that occurs, and of those at one place the longest
    pattern = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) or r"(?!)")
    for text in texts:
        own: list[tuple[int, int | None]] = []
        at = 0
        for found in pattern.finditer(text):
            own += [(len(segments), None), (-1, specials[found[0]])]
            segments.append(text[at : found.start()])
            at = found.end()
        own.append((len(segments), None))
        segments.append(text[at:])
        parts.append(own)
    return segments, parts


def put_together(flat: np.ndarray, bounds: np.ndarray, parts: list[list[tuple[int, int | None]]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts from the ids of their segments."""
    if all(len(p) == 1 for p in parts):
        return flat, bounds
    rows = [np.concatenate([flat[bounds[k] : bounds[k + 1]] if k >= 0 else np.array([special], flat.dtype) for k, special in own]) for own in parts]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def column_texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]
