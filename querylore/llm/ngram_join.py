"""Jaccard self join of documents by word shingles, as a join in a metric space.

The Jaccard distance 1 - J is a metric, and two documents are linked when it is at most ``1 - threshold`` (eps).

1. Equal shingle sets are one class; only the class with the smallest doc_id goes on.
2. Unrelated documents all lie at distance 1 from each other, where no triangle inequality can tell them apart. So regions are
   opened only between sets that can be close: a set is replicated into the cells of its rarest shingles, as many as a set
   within eps cannot miss (rarity by a count-min sketch of all shingles; any order gives the same links). Two linked sets
   share at least one such cell.
3. A cell of a few sets is a leaf: its pairs are compared, but for those whose sizes or positions in the cells' order rule out a
   link. Each larger cell elects a pivot. The sets around one pivot form its region. Each member that a count vector (see 4) does
   not prove farther than eps from the pivot is compared with it exactly. Members linked to the pivot are in one component and
   need no comparison with each other.
4. What a pivot leaves open, regions whose members are in several components, is joined recursively: more pivots inside the
   region split it into Voronoi cells by nearest pivot, members in the window d(x, q) <= d(x, nearest) + 2 eps are replicated to
   pivot q, and small cells are compared pair by pair. This runs on count vectors of the sets over 128 hash bins, whose
   weighted Jaccard distance is a metric too and never above the sets' own distance, so no link is lost; the pairs found are then
   compared exactly. A region too large for one task is dealt into blocks of rows first.

``links`` holds class pairs (a, b): every linked pair is either in it, or both ends are joined by pairs in it. It gives the components.

5. All links are counted inside the components, which no link leaves. The classes of a component are dealt into blocks, each pair of
   blocks is one task's work, and each pair of classes meets in exactly one of them and is compared exactly. Only sums per class leave a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylore.llm.arrays import Words, lists, pieces, span_hashes
from querylore.llm.common import components, stored
from querylore.llm.sketch import Shared, bits_for, merged

SHINGLE = 5
THRESHOLD = (80, 100)  # a link: 100 * intersection >= 80 * union
CELL = 1024  # members compared with a pivot in one group
LEAF = 48
BINS = 128
LEAF_CELL = 16  # sets of a cell that are compared pair by pair
POSITION_BITS = 20  # later positions count as the last one, which only weakens a bound
PAIR_ROWS, PAIR_SHINGLES = 2048, 1 << 19  # classes, and shingles of them, in a block whose pairs are counted
OFTEN = 64  # a shingle of more sets of two blocks is counted by a matrix product
KEY_SHIFT = 24  # cell keys keep 40 bits of a shingle hash; a false meeting only costs a comparison


def shingles(batch: pa.RecordBatch, column: int, size: int = SHINGLE):
    """Sorted distinct shingle hashes of each row: flat values and row bounds."""
    words = Words(batch.column(column), lower=True)
    grams, _, bounds = words.grams(size)
    short = np.diff(words.first)
    whole = np.flatnonzero((short > 0) & (short < size))
    short_hash = dict(zip(whole.tolist(), span_hashes(words.hashes, words.first[whole], words.first[whole + 1])))
    rows = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(batch.num_rows)]
    for i, h in short_hash.items():
        rows[i] = np.array([h], np.uint64)
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint64)), ends


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def least_shared(n: int, threshold: tuple[int, int]) -> int:
    """Shingles that a set of n must share with any linked set."""
    return -(-n * threshold[0] // threshold[1])


def _sets(texts: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, n_shingles, set_key, cells) of each document; cells are the keys of its rarest shingles."""
    total = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(total / 6 / 512)  # some 64 shingles a cell: only clearly frequent ones must stand out

    def all_shingles(batches):
        for batch in pieces(batches, "text"):
            yield shingles(batch, 1, size)[0]

    sketch = merged(texts, bits, all_shingles)
    usual = max(1.0, float(np.median(sketch.table)))
    shared = Shared(texts, sketch)

    def build(batches):
        table = shared.get()
        for batch in pieces(batches, "text"):
            flat, ends = shingles(batch, 1, size)
            seen = table.estimate(flat).astype(np.float64)
            rank = np.clip(np.log2(np.maximum(seen / usual, 1.0)) * 4, 0, 63).astype(np.uint64)
            order = (rank << np.uint64(58)) | (flat >> np.uint64(6))
            n, keys, cells, bounds, fold = np.diff(ends), [], [], [0], []
            for i in range(batch.num_rows):
                own = flat[ends[i] : ends[i + 1]]
                keys.append(set_key(own))
                take = len(own) - least_shared(len(own), threshold) + 1 if len(own) else 0
                cells.append(own[np.argsort(order[ends[i] : ends[i + 1]], kind="stable")[:take]])
                bounds.append(bounds[-1] + take)
                fold.append(np.minimum(np.bincount((own & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
            flat_cells = (np.concatenate(cells) >> np.uint64(KEY_SHIFT)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys, pa.binary()), lists(flat_cells, np.array(bounds)), pa.array(fold, pa.binary())], ["doc_id", "n_shingles", "set_key", "cells", "fold"])

    return texts.mapInArrow(build, "doc_id long, n_shingles long, set_key binary, cells array<long>, fold binary")


def folds(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Count vectors of sets over ``BINS`` hash bins, with what saturated bytes lost in one more coordinate."""
    counts = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), BINS).astype(np.int32)
    return np.column_stack([counts, sizes.astype(np.int32) - counts.sum(1, dtype=np.int32)])


def fold_distances(points: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
    """Weighted Jaccard distance of each count vector to one of them: a metric, never above the sets' own distance."""
    apart = np.abs(points - points[at]).sum(1)
    return 2 * apart / np.maximum(sizes + sizes[at] + apart, 1)


def metric_join(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Positions (i, j), i < j, of different labels within eps, by recursive Voronoi cells with windows of twice eps."""
    found: set[tuple[int, int]] = set()

    def leaf(members):
        own, n = points[members], sizes[members]
        for k in range(len(members) - 1):
            near = fold_distances(own[k:], n[k:], 0) <= eps + 1e-9
            for hit in np.flatnonzero(near & (labels[members[k:]] != labels[members[k]])):
                i, j = sorted((int(members[k]), int(members[k + hit])))
                found.add((i, j))

    def split(members):
        if len(members) <= LEAF or (labels[members] == labels[members[0]]).all():
            return leaf(members) if (labels[members] != labels[members[0]]).any() else None
        own, n = points[members], sizes[members]
        # each pivot is the set farthest from those before it, so that sparse parts get pivots too
        pivot, away, nearest = 0, [], np.full(len(members), 2.0)
        for _ in range(max(2, int(len(members) ** 0.5))):
            away.append(fold_distances(own, n, pivot))
            nearest = np.minimum(nearest, away[-1])
            pivot = int(np.argmax(nearest))
            if nearest[pivot] <= 0:
                break
        # let p be the nearest pivot of x, q that of y, and y within eps of x: then d(y, p) <= d(x, p) + eps <= d(x, q) + eps
        # <= d(y, q) + 2 eps, so y is in the window of p and meets x there
        inside = np.stack(away) <= nearest + 2 * eps + 1e-9
        if inside.sum() > 0.7 * inside.size or inside.all(1).any():
            return leaf(members)  # distances too alike for windows to part the region
        for row in inside:
            if row.sum() > 1:
                split(members[row])

    if len(sizes) > 1:
        split(np.arange(len(sizes)))
    return sorted(found)


def _arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.combine_chunks()
    bounds = values.offsets.to_numpy().astype(np.int64)
    return values.flatten().to_numpy().view(np.uint64), bounds - bounds[0]


def id_keys(batches):
    for batch in batches:
        yield batch.column(0).to_numpy().astype(np.int64).view(np.uint64)


def _verified(texts: DataFrame, pairs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """The linked ones among the pairs (x, p), by exact comparison of whole sets, as stored (a, b).

    Pairs are grouped by p, at most ``CELL`` at a time, each group with its own copy of p's set.
    """
    ids = pairs.select("x").unionByName(pairs.select(F.col("p").alias("x"))).distinct()

    wanted = Shared(ids, merged(ids, bits_for(pairs.count() * 2), id_keys))

    def hashed(batches):
        table = wanted.get()
        for batch in pieces(batches, "text"):
            batch = batch.filter(pa.array(table.estimate(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) > 0))
            if batch.num_rows:
                flat, ends = shingles(batch, 1, size)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(flat.view(np.int64), ends)], ["x", "hashes"])

    def compare(table: pa.Table) -> pa.Table:
        p, x = table.column("p")[0].as_py(), table.column("x").to_numpy()
        flat, ends = _arrays(table.column("hashes"))
        linked = np.zeros(len(x), bool)
        for k in np.flatnonzero(x == p):  # several where rows share the doc_id p
            pivot = flat[ends[k] : ends[k + 1]]
            at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
            hits = np.concatenate([[0], np.cumsum(pivot[at] == flat)])
            both = hits[ends[1:]] - hits[ends[:-1]]
            linked |= threshold[1] * both >= threshold[0] * (np.diff(ends) + len(pivot) - both)
        out = np.unique(x[linked & (x != p)])
        return pa.table({"a": pa.array(out, pa.int64()), "b": pa.array(np.full(len(out), p), pa.int64())})

    # the sketch of wanted ids keeps most texts out of the shuffle; the join drops what it lets through by chance
    sets = texts.mapInArrow(hashed, "x long, hashes array<long>").filter(F.size("hashes") > 0)
    groups = pairs.groupBy("p").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    dealt = pairs.join(groups, "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"))
    own = groups.select("p", F.col("p").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return stored(dealt.unionByName(own).join(sets, "x").groupBy("p", "part").applyInArrow(compare, "a long, b long"), "links")


def _region(eps: float):
    def run(table: pa.Table) -> pa.Table:
        x, one = np.unique(table.column("x").to_numpy(), return_index=True)
        sizes, labels = table.column("n").to_numpy()[one], table.column("label").to_numpy()[one]
        blobs = table.column("fold").to_pylist()
        pairs = metric_join(folds([blobs[i] for i in one], sizes), sizes, labels, eps)
        return pa.table({"x": pa.array([int(x[j]) for _, j in pairs], pa.int64()), "p": pa.array([int(x[i]) for i, _ in pairs], pa.int64())})

    return run


def _near_fold(eps: float):
    def run(batches):
        for batch in batches:
            nx, np_ = batch.column("n").to_numpy(), batch.column("np").to_numpy()
            apart = np.abs(folds(batch.column("fold").to_pylist(), nx) - folds(batch.column("foldp").to_pylist(), np_)).sum(1) if batch.num_rows else np.zeros(0)
            keep = 2 * apart <= (eps + 1e-9) * (nx + np_ + apart)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column("x"), batch.column("p"))], ["x", "p"])

    return run


def _meetings(filled: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Stored, distinct (x, p, leaf): pairs of a small cell that sizes and positions allow, or a member of a large cell and its pivot.

    Cells list a set's shingles in one order. In the first cell that two linked sets share, at positions i and j, at most
    min(n - i, m - j) shingles can be shared, and a link needs threshold * (n + m) / (1 + threshold) of them.
    """
    top, whole = threshold
    packed = F.shiftleft("n_shingles", POSITION_BITS) + F.least(F.col("i"), F.lit((1 << POSITION_BITS) - 1))
    spread = filled.select(F.col("class_id").alias("x"), "n_shingles", F.posexplode("cells").alias("i", "cell")).select("cell", "x", packed.alias("ni"))
    cells = spread.groupBy("cell").agg(F.min("x").alias("p"), F.count("*").alias("m")).filter("m > 1")
    met = spread.join(cells, "cell")
    n, left = lambda r: F.shiftright(r["ni"], POSITION_BITS), lambda r: F.shiftright(r["ni"], POSITION_BITS) - r["ni"].bitwiseAND(F.lit((1 << POSITION_BITS) - 1))

    def can_link(a, b):
        sizes = (F.greatest(n(a), n(b)) * top <= F.least(n(a), n(b)) * whole) & (a["x"] > b["x"])
        return sizes & (F.least(left(a), left(b)) * (top + whole) >= (n(a) + n(b)) * top)

    group = met.filter(F.col("m") <= LEAF_CELL).groupBy("cell").agg(F.collect_list(F.struct("x", "ni")).alias("own"))  # at most LEAF_CELL rows
    pairs = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: can_link(a, b)), lambda b: F.struct(a["x"].alias("x"), b["x"].alias("p")))))
    small = group.select(F.explode_outer(pairs).alias("pair")).filter("pair is not null").select("pair.x", "pair.p").distinct().withColumn("leaf", F.lit(True))
    large = met.filter((F.col("m") > LEAF_CELL) & (F.col("x") != F.col("p"))).select("x", "p").distinct().withColumn("leaf", F.lit(False))
    return stored(small.unionByName(large), "meetings")


def _links(texts: DataFrame, classes: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    eps = 1 - threshold[0] / threshold[1]
    filled = classes.filter("n_shingles > 0")
    meetings = _meetings(filled, threshold)
    points = filled.select(F.col("class_id").alias("x"), F.col("n_shingles").alias("n"), "fold")

    pivot = points.select(F.col("x").alias("p"), F.col("n").alias("np"), F.col("fold").alias("foldp"))
    near = meetings.select("x", "p").distinct().join(points, "x").join(pivot, "p").mapInArrow(_near_fold(eps), "x long, p long").distinct()
    stars = _verified(texts, stored(near, "stars"), size, threshold)

    labels = components(stars)
    members = meetings.filter("not leaf").select("x", "p")
    named = members.join(labels.withColumnRenamed("node", "x"), "x", "left").select("x", "p", F.coalesce("component", "x").alias("label"))
    # members of one region that are all in one component already have nothing left to settle
    open_ = named.groupBy("p").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).filter("low < high")
    rows = named.join(points, "x").join(open_.select("p", F.ceil(F.col("m") / CELL).cast("int").alias("parts")), "p").withColumn("own", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rest = rows.select("p", "i", "j", "x", "n", "fold", "label").groupBy("p", "i", "j").applyInArrow(_region(eps), "x long, p long").distinct()
    return stars.unionByName(_verified(texts, stored(rest, "rest"), size, threshold))


def shared_counts(flat: np.ndarray, row: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each of the rows ``a`` shares with each of the rows ``b``; ``flat`` are the distinct values of each of n rows.

    ``a`` comes before ``b`` or is the same; then only the part above the diagonal counts. Rare values are counted pair by pair.
    """
    _, value, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((row, value))
    order = order[often[value[order]] > 1]  # a value of one row is shared with none
    value, row = value[order], row[order]
    out = np.zeros((len(a), len(b)), np.int32)
    shift = 0 if a is b or len(a) == n else len(a)
    rare = often[value] <= OFTEN
    v, r = value[rare], row[rare]
    for lag in range(1, OFTEN):
        same = np.flatnonzero(v[lag:] == v[:-lag]) if lag < len(v) else np.zeros(0, np.int64)
        if not len(same):
            break
        x, y = r[same], r[same + lag]
        met = (x < len(a)) & (y >= shift)
        np.add.at(out, (x[met], y[met] - shift), 1)
    v, r = value[~rare], row[~rare]
    bounds = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]])) if len(v) else np.zeros(1, np.int64)
    for k in range(0, len(bounds) - 1, 1024):
        to = min(k + 1024, len(bounds) - 1)
        own = slice(bounds[k], bounds[to])
        has = np.zeros((n, to - k), np.float32)
        has[r[own], np.searchsorted(bounds[k : to + 1], np.arange(bounds[k], bounds[to]), "right") - 1] = 1
        out += (has[a] @ has[b].T).astype(np.int32)
    return out


def _pair_counts(size: int, threshold: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        flats, keys, copies, first = [], [], [], []
        for batch in pieces(table.select(["text", "set_key", "copies", "first"]).to_batches(), "text"):
            flat, ends = shingles(batch, 0, size)
            for i, key in enumerate(batch.column(1).to_pylist()):
                own = flat[ends[i] : ends[i + 1]]
                if set_key(own) == key:  # not so for other rows that repeat the doc_id
                    flats.append(own)
                    keys.append(key)
                    copies.append(batch.column(2)[i].as_py())
                    first.append(batch.column(3)[i].as_py())
        rank = {key: at for at, key in enumerate(dict.fromkeys(keys))}
        one = [keys.index(key) for key in rank] if len(rank) < len(keys) else list(range(len(keys)))
        one.sort(key=lambda at: not first[at])  # the rows of the first block come first
        flats, keys = [flats[at] for at in one], [keys[at] for at in one]
        copies, n_first = np.array([copies[at] for at in one], np.float64), sum(first[at] for at in one)
        n = np.array([len(f) for f in flats], np.int64)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        a = np.arange(len(n) if within else n_first)
        b = a if within else np.arange(n_first, len(n))
        others = np.zeros(len(n))
        if len(a) and len(b):
            both = shared_counts(np.concatenate(flats), np.repeat(np.arange(len(n)), n), len(n), a, b)
            for k in range(0, len(a), 256):  # rows at a time, as exact numbers are wide
                part = both[k : k + 256].astype(np.float64)
                linked = threshold[1] * part >= threshold[0] * (n[a[k : k + 256], None] + n[None, b] - part)
                if within:
                    linked &= np.arange(k, k + len(part))[:, None] < b[None, :]
                others[a[k : k + 256]] += linked @ copies[b]
                others[b] += copies[a[k : k + 256]] @ linked
        return pa.table({"set_key": pa.array(keys, pa.binary()), "others": pa.array(others.astype(np.int64))})

    return run


def _link_counts(texts: DataFrame, named: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Stored (set_key, others): of the classes that have any, the rows in other classes that are linked with a row of the class."""
    groups = named.groupBy("component_id").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total")).filter("m > 1")
    parts = F.ceil(F.greatest(F.col("m") / PAIR_ROWS, F.col("total") / PAIR_SHINGLES)).cast("int")
    wanted = stored(named.join(groups.select("component_id", parts.alias("parts")), "component_id").select("class_id", "set_key", "component_id", "copies", "parts"), "counted")
    ids = wanted.select("class_id").distinct()
    held = Shared(ids, merged(ids, bits_for(wanted.count() * 2), id_keys))

    def likely(batches):
        table = held.get()
        for batch in batches:
            batch = batch.filter(pa.array(table.estimate(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) > 0))
            if batch.num_rows:
                yield batch

    rows = texts.mapInArrow(likely, "class_id long, text string").join(wanted, "class_id").withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.select("component_id", "i", "j", "text", "set_key", "copies", (F.col("own") == F.col("i")).alias("first"))
    sums = rows.groupBy("component_id", "i", "j").applyInArrow(_pair_counts(size, threshold), "set_key binary, others long")
    return stored(sums.groupBy("set_key").agg(F.sum("others").alias("others")), "link-counts")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def link_tables(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links) of the documents with a doc_id: sets (doc_id, n_shingles, set_key), classes (class_id, copies, n_shingles)."""
    texts = _texts(docs)
    sets = stored(_sets(texts, size, threshold), "sets")
    full = sets.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("cells").alias("cells"), F.first("fold").alias("fold"))
    links = _links(texts, full, size, threshold)
    return sets.drop("cells", "fold"), full.select("set_key", "class_id", "copies", "n_shingles"), links


def _named(docs: DataFrame, size: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The sets, and their classes that have shingles with component_id."""
    sets, classes, links = link_tables(docs, size, threshold)
    labels = components(links)
    filled = classes.filter("n_shingles > 0").join(labels, classes["class_id"] == labels["node"], "left")
    return sets, filled.select("set_key", "class_id", F.coalesce("component", "class_id").alias("component_id"), "copies", "n_shingles")


def ngram_jaccard_join(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links) for each row of ``docs`` (doc_id, text, ...).

    class_id is the smallest doc_id with the same shingle set, component_id the smallest reachable over links, n_links the number
    of other rows with a doc_id that are linked with this one, copies included.
    A null, empty or blank text has no set: 0 shingles, linked with nothing. Fewer than ``size`` words are one shingle.
    Rows that repeat a doc_id count as one document in components, as rows in n_links, and keep a row each. Rows without a doc_id
    are returned with nulls, their own shingles not counted. Other columns of ``docs`` are ignored. An empty table gives
    an empty table. Links come from exact comparison of 64-bit shingle hashes.
    """
    sets, named = _named(docs, size, threshold)
    named = stored(named, "named")
    named = named.join(_link_counts(_texts(docs), named, size, threshold), "set_key", "left")
    named = named.select("set_key", "class_id", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = sets.join(named, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    nameless = docs.filter(F.col("doc_id").isNull()).select(*[F.lit(None).cast("long").alias(c) for c in out.columns])
    return out.unionByName(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the document with the smallest doc_id stays, all columns kept.

    Rows without a doc_id stay. Of rows that repeat the kept doc_id, all stay.
    """
    sets, named = _named(docs.select("doc_id", "text"), SHINGLE, THRESHOLD)
    dropped = sets.join(named.select("set_key", "component_id"), "set_key").filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
