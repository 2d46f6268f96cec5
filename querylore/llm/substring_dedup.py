"""Removal of long word sequences that an earlier document already has.

Pass 1 counts windows in a count-min sketch. Every window of ``size`` words is counted through its anchor: the gram of
``GRAM`` words with the least hash among the grams inside the window. Equal windows have equal anchors, so an anchor's
count is never below the number of places where its windows start, and a partition sketch needs one entry for a run of
windows instead of one each.
Pass 2 groups exactly, and only, windows whose estimate is two or more: per window hash the smallest doc_id, a sum that
shrinks before the shuffle however often a passage occurs. Each window hash goes back to the one document that owns it, so a
document gets at most its own windows. What a document holds of estimated windows but does not own starts in a smaller doc_id.
A false estimate only sends a window through pass 2 in vain; none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylore.llm.arrays import Words, pieces, sliding_min, span_hashes
from querylore.llm.common import free_name
from querylore.llm.sketch import Repeated, Twice, bits_for, merged

SIZE = 50
GRAM = 16


def _windows(words: Words, size: int, gram: int):
    """Start positions of all windows, their row, and the anchor of each; plus anchors without neighbouring repeats."""
    m = len(words.hashes)
    row_end = np.repeat(words.first[1:], np.diff(words.first))
    at = np.flatnonzero(row_end - np.arange(m) >= size)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return at, none, none
    starts = np.arange(m - gram + 1)
    anchors = sliding_min(span_hashes(words.hashes, starts, starts + gram), size - gram + 1)[at]
    row = np.searchsorted(words.first, at, "right")
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    return at, anchors, anchors[new]


def remove_repeated_windows(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with kept_text, n_words and n_removed in place of nothing else.

    A word goes when some window of ``size`` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. kept_text has the kept words joined by one space. A null, blank or short text loses nothing (null gives
    an empty kept_text). Repeats inside one document, and rows that share a doc_id, do not count as earlier. Rows without a
    doc_id lose nothing and are no source. All other columns stay, whatever their names, except kept_text, n_words and n_removed,
    which are replaced. An empty table gives an empty table. Windows are told apart by 64-bit hashes.
    """
    gram = min(gram, size)
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(total / 6 * 2 / (size - gram + 2))

    def anchors(batches):
        for batch in pieces(batches, "text"):
            yield _windows(Words(batch.column(1), lower=False), size, gram)[2]

    again = Repeated(texts, merged(texts, bits, anchors, Twice))

    def repeated(words):
        at, anchors, _ = _windows(words, size, gram)
        at = at[again.test(anchors)] if len(at) else at
        return at, span_hashes(words.hashes, at, at + size)

    def estimated(batches):
        for batch in pieces(batches, "text"):
            words = Words(batch.column(1), lower=False)
            at, hashes = repeated(words)
            ids = batch.column(0).to_numpy()[np.searchsorted(words.first, at, "right") - 1]
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            one = np.ones(len(hashes), bool)
            one[1:] = hashes[1:] != hashes[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[one].view(np.int64)), pa.array(ids[one])], ["window", "doc_id"])

    owners = texts.mapInArrow(estimated, "window long, doc_id long").groupBy("window").agg(F.min("doc_id").alias("doc_id"))
    rest = docs.drop("kept_text", "n_words", "n_removed")
    mine_name = free_name(rest, "owned")
    owned = owners.groupBy("doc_id").agg(F.collect_list("window").alias(mine_name))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema)}, kept_text string, n_words long, n_removed long"
    names = rest.columns
    text_at, id_at = names.index("text"), names.index("doc_id")

    def cut(batches):
        for batch in pieces(batches, "text"):
            words = Words(batch.column(text_at), lower=False)
            at, hashes = repeated(words)
            row = np.searchsorted(words.first, at, "right") - 1
            mine = batch.column(mine_name)
            named = batch.column(id_at).is_valid().to_numpy(zero_copy_only=False)
            kept, n_words, n_removed = [], np.diff(words.first), np.zeros(batch.num_rows, np.int64)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i in range(batch.num_rows):
                a, b = words.first[i], words.first[i + 1]
                keep = np.ones(b - a, bool)
                if named[i] and bounds[i] < bounds[i + 1]:
                    own = mine[i].values
                    own = np.zeros(0, np.uint64) if own is None else own.to_numpy(zero_copy_only=False).view(np.uint64)
                    here = slice(bounds[i], bounds[i + 1])
                    starts = at[here][~np.isin(hashes[here], own)] - a
                    cover = np.zeros(b - a + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + size, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                n_removed[i] = (b - a) - keep.sum()
                kept.append(_joined(words, a, b, keep))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))] + [pa.array(kept, pa.string()), pa.array(n_words), pa.array(n_removed)], [*names, "kept_text", "n_words", "n_removed"])

    return rest.join(owned, "doc_id", "left").select(*names, mine_name).mapInArrow(cut, schema)


def _joined(words: Words, a: int, b: int, keep: np.ndarray) -> str:
    if b == a:
        return ""
    raw = words.raw[words.starts[a] : words.ends[b - 1]].tobytes()
    if keep.all():
        return b" ".join(raw.split()).decode()
    return b" ".join(w for w, k in zip(raw.split(), keep) if k).decode()
