"""Counting quotient filters of word-id n-grams: exact counters in a few bytes each.

An n-gram of word ids is packed into limbs of at most 64 bits and permuted, one to one. The leading bits of the permuted number are its
quotient, all others its remainder. A filter stores, for each quotient in order, how many remainders it has, the remainders in full and a
count for each, so nothing is lost and the n-gram can be had back. Filters are sorted by construction: two of one kind are merged by
one pass, and since a permutation spreads every key alike, a range of quotients is an equal share of the work whatever the n-grams are.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from querylore.llm.arrays import mix

_ODD = 0x9FB21C651E98DF25
_STEPS = [np.uint64(0xD1342543DE82EF95), np.uint64(0xA26846A7BD05DF2A)]


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


class Packing:
    """``n`` ids of ``bits`` bits each as limbs of whole ids, and the permutation of these limbs."""

    def __init__(self, n: int, bits: int):
        if not 1 <= bits <= 32:
            raise ValueError("ids have 1 to 32 bits")
        per = 64 // bits
        self.n, self.bits = n, bits
        self.words = [min(per, n - i) for i in range(0, n, per)]
        self.widths = [w * bits for w in self.words]

    def pack(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        limbs, at = [], 0
        for words in self.words:
            limb = np.zeros(len(columns[0]), np.uint64)
            for column in columns[at : at + words]:
                limb = (limb << np.uint64(self.bits)) | column.astype(np.uint64)
            limbs.append(limb)
            at += words
        return limbs

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        columns = []
        for limb, words in zip(limbs, self.words):
            columns += [((limb >> np.uint64(self.bits * k)) & _mask(self.bits)).astype(np.int64) for k in reversed(range(words))]
        return columns

    def _around(self, limbs: list[np.ndarray], i: int, r: int) -> np.ndarray:
        return mix(limbs[(i + 1) % len(limbs)] + _STEPS[r])

    def permute(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        limbs = list(limbs)
        for r in range(len(_STEPS)):
            for i, width in enumerate(self.widths):
                mask, shift = _mask(width), np.uint64((width + 1) // 2)
                limb = limbs[i] if len(limbs) == 1 else (limbs[i] + self._around(limbs, i, r)) & mask
                limb = ((limb ^ (limb >> shift)) * np.uint64(_ODD)) & mask
                limbs[i] = limb ^ (limb >> shift)
        return limbs

    def restore(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        """The inverse of ``permute``."""
        limbs = list(limbs)
        for r in reversed(range(len(_STEPS))):
            for i in reversed(range(len(limbs))):
                width = self.widths[i]
                mask, shift = _mask(width), np.uint64((width + 1) // 2)
                limb = limbs[i] ^ (limbs[i] >> shift)
                limb = (limb * np.uint64(pow(_ODD, -1, 1 << width))) & mask
                limb = limb ^ (limb >> shift)
                limbs[i] = limb if len(limbs) == 1 else (limb - self._around(limbs, i, r)) & mask
        return limbs


def _narrow(values: np.ndarray, width: int) -> bytes:
    """Little-endian numbers in as few whole bytes as ``width`` bits need."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)]).tobytes()


def _wide(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out, size = np.zeros((n, 8), np.uint8), -(-width // 8)
    if size:
        out[:, :size] = data[: n * size].reshape(n, size)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Non-negative numbers as one byte each; those of 255 and more follow in full, with their number first."""
    big = values[values >= 255]
    return np.array([len(big)], "<u8").tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + big.astype("<u8").tobytes()


def _from_small(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    big = int(data[:8].copy().view("<u8")[0])
    values = data[8 : 8 + n].astype(np.int64)
    end = 8 + n + 8 * big
    values[values == 255] = data[8 + n : end].copy().view("<u8").astype(np.int64)
    return values, data[end:]


class QuotientFilter:
    """Sorted distinct permuted keys (limbs) and their counts."""

    def __init__(self, packing: Packing, limbs: list[np.ndarray], counts: np.ndarray):
        self.packing, self.limbs, self.counts = packing, limbs, counts

    @classmethod
    def count(cls, packing: Packing, limbs: list[np.ndarray], counts: np.ndarray | None = None) -> QuotientFilter:
        """A filter of permuted keys in any order, with repeats; sorted runs that follow each other are merged, not sorted anew."""
        n = len(limbs[0])
        if len(limbs) == 1 and counts is None:
            limbs = [np.sort(limbs[0])]
        elif len(limbs) == 1:
            order = np.argsort(limbs[0], kind="stable")
            limbs, counts = [limbs[0][order]], counts[order]
        else:
            order = np.lexsort(limbs[::-1])
            limbs, counts = [limb[order] for limb in limbs], None if counts is None else counts[order]
        new = np.zeros(n, bool)
        new[:1] = True
        for limb in limbs:
            new[1:] |= limb[1:] != limb[:-1]
        begins = np.flatnonzero(new)
        if counts is None:
            counts = np.diff(np.append(begins, n))
        elif n:
            counts = np.add.reduceat(counts, begins)
        return cls(packing, [limb[begins] for limb in limbs], counts.astype(np.int64))

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all of them together, merged pairwise, the smallest first."""
        rest = sorted(filters, key=len)
        while len(rest) > 1:
            pairs = [rest[i : i + 2] for i in range(0, len(rest), 2)]
            rest = [
                p[0] if len(p) == 1 else cls.count(p[0].packing, [np.concatenate(two) for two in zip(p[0].limbs, p[1].limbs)], np.concatenate([p[0].counts, p[1].counts]))
                for p in pairs
            ]
        return rest[0]

    def __len__(self) -> int:
        return len(self.counts)

    def ranges(self, range_bits: int) -> list[tuple[int, QuotientFilter]]:
        """The filter cut at the leading ``range_bits`` bits, empty parts left out."""
        range_bits = min(range_bits, self.packing.widths[0])
        shift = np.uint64(self.packing.widths[0] - range_bits)
        owner = (self.limbs[0] >> shift) if range_bits else np.zeros(len(self), np.uint64)
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(self) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(self))
        return [(int(owner[a]), QuotientFilter(self.packing, [limb[a:b] for limb in self.limbs], self.counts[a:b])) for a, b in zip(begins, ends)]

    @cached_property
    def quotient_bits(self) -> int:
        """About two keys a quotient, counted over the range of quotients that the filter's keys span."""
        first = self.packing.widths[0]
        if not len(self):
            return 0
        span = int(self.limbs[0][-1] - self.limbs[0][0]).bit_length()
        return max(0, min(first, first - span + max(0, (len(self) // 2).bit_length())))

    def to_bytes(self) -> bytes:
        q, first = self.quotient_bits, self.packing.widths[0]
        rest = first - q
        quotient = (self.limbs[0] >> np.uint64(rest)) if q else np.zeros(len(self), np.uint64)
        begin = int(quotient[0]) if len(self) else 0
        runs = np.bincount((quotient - np.uint64(begin)).astype(np.int64)) if len(self) else np.zeros(0, np.int64)
        head = np.array([self.packing.n, self.packing.bits, len(self), q, begin, len(runs)], "<u8").tobytes()
        remainders = [_narrow(self.limbs[0] & _mask(rest) if rest else np.zeros(len(self), np.uint64), rest)]
        remainders += [_narrow(limb, width) for limb, width in zip(self.limbs[1:], self.packing.widths[1:])]
        return b"".join([head, *remainders, _small(runs), _small(self.counts - 1)])

    @classmethod
    def from_bytes(cls, blob: bytes) -> QuotientFilter:
        n, bits, size, q, begin, spread = (int(v) for v in np.frombuffer(blob[:48], "<u8"))
        packing, data, limbs = Packing(n, bits), np.frombuffer(blob, np.uint8)[48:], []
        for width in [packing.widths[0] - q, *packing.widths[1:]]:
            limbs.append(_wide(data, size, width))
            data = data[size * -(-width // 8) :]
        runs, data = _from_small(data, spread)
        counts, _ = _from_small(data, size)
        if q:
            limbs[0] |= (np.repeat(np.arange(spread, dtype=np.uint64), runs) + np.uint64(begin)) << np.uint64(packing.widths[0] - q)
        return cls(packing, limbs, counts + 1)

    def at_least(self, least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The ids (one column a word), first limbs and counts of the n-grams counted ``least`` times or more."""
        kept = np.flatnonzero(self.counts >= least)
        limbs = [limb[kept] for limb in self.limbs]
        return self.packing.unpack(self.packing.restore(limbs)), limbs[0], self.counts[kept]
