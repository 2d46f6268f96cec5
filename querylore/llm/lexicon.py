"""A minimal acyclic transducer from words to id sequences, in flat arrays that can be memory-mapped.

Words are added in byte order; states with equal remainders are merged as soon as they are complete, so common endings are stored
once. Each arc carries the number of words that leave its state by smaller arcs, so the sum along a word's path is its rank, and the
rank finds its ids in one table.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "words", "number")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final, self.words, self.number = False, 0, -1

    def key(self):
        return self.final, tuple((label, id(target)) for label, target in self.arcs.items())


def compile_lexicon(entries: Iterable[tuple[bytes, np.ndarray]]) -> bytes:
    """The transducer of (word, ids) entries with distinct, non-empty words, as one blob."""
    entries = sorted(entries, key=lambda e: e[0])
    root, register = _State(), {}
    path: list[tuple[_State, int, _State]] = []  # open arcs of the last word

    def close(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            same = register.setdefault(child.key(), child)
            parent.arcs[label] = same

    before = b""
    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        close(shared)
        state = path[-1][2] if path else root
        for label in word[shared:]:
            child = _State()
            state.arcs[label] = child
            path.append((state, label, child))
            state = child
        state.final = True
        before = word
    close(0)

    order: list[_State] = []

    def visit(top: _State) -> None:
        """Children first, without recursion."""
        stack = [(top, iter(list(top.arcs.values())))]
        while stack:
            state, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                if state.number < 0:
                    state.words = int(state.final) + sum(t.words for t in state.arcs.values())
                    state.number = len(order)
                    order.append(state)
                stack.pop()
            elif child.number < 0:
                stack.append((child, iter(list(child.arcs.values()))))

    visit(root)
    keys, targets, outputs = [], [], []
    for state in order:
        passed = int(state.final)
        for label in sorted(state.arcs):
            target = state.arcs[label]
            keys.append(state.number * 256 + label)
            targets.append(target.number)
            outputs.append(passed)
            passed += target.words
    sizes = np.array([len(ids) for _, ids in entries], np.int64)
    parts = [
        np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array([s.final for s in order], np.int64),
        np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.zeros(0, np.int64), *[np.asarray(ids, np.int64) for _, ids in entries]]),
    ]
    head = np.array([root.number, *map(len, parts)], np.int64)
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """Read access to a compiled transducer through a memory map; the file has no name and goes with the process."""

    def __init__(self, blob: bytes):
        file = tempfile.TemporaryFile()
        file.write(blob)
        file.flush()
        data = np.memmap(file, np.int64, "r")
        self.root, at, parts = int(data[0]), 7, []
        for size in data[1:7]:
            parts.append(data[at : at + size])
            at += size
        self.keys, self.targets, self.outputs, self.final, self.bounds, self.ids = parts

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those not in the lexicon; all words take each step together."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live, step = np.flatnonzero(sizes > 0), 0
        rank[sizes == 0] = -1
        while len(live) and len(self.keys):
            want = state[live] * 256 + raw[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            rank[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            rank[live] += self.outputs[at]
            step += 1
            ended = sizes[live] == step
            done = live[ended]
            rank[done] = np.where(self.final[state[done]] == 1, rank[done], -1)
            live = live[~ended]
        if not len(self.keys):
            rank[:] = -1
        return rank

    def spans(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these ranks begin in ``ids``, and how many they are."""
        begins = np.asarray(self.bounds[ranks])
        return begins, np.asarray(self.bounds[ranks + 1]) - begins
