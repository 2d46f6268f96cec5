"""Language identification: averaged hashed sub-word embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A text's features are its sub-words of two to four bytes inside words (with the blank before and after as their marks), hashed into
``BUCKETS`` rows of an embedding table. The text's vector is their mean; a linear layer and a softmax follow. Because both are linear, table and
layer are multiplied into one table of class scores before it is sent to the tasks, and a whole text is scored by a mean of rows.

Training uses a bounded sample: of each language the ``SAMPLE`` labelled rows with the least hash of doc_id, up to ``SAMPLE_BYTES``, whole texts. A
tenth of it is held back to calibrate a temperature and the score below which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylore.llm.arrays import pieces, text_bytes
from querylore.llm.common import free_name

BUCKETS_BITS = 15
BUCKETS = 1 << BUCKETS_BITS
DIMENSIONS = 16
SAMPLE = 800  # rows of each language
SAMPLE_BYTES = 16 << 20  # of text of each language
EPOCHS = 4
RATE = 0.6
REJECT_SHARE = 0.001  # of rightly predicted held-back texts may fall below the rejection score
REJECT_MOST = 0.5  # a prediction at or above this score is never rejected
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(raw: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each sub-word size the table row of the sub-word at every byte; ``BUCKETS`` where none begins."""
    data = _FOLD[raw].astype(np.uint32)
    n = len(data)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    blank = data == 32
    out = []
    for size in (2, 3, 4):
        code = np.zeros(n, np.uint32)
        bad = room < size
        for j in range(size):
            shifted = np.zeros(n, np.uint32)
            shifted[: max(0, n - j)] = data[j:]
            code |= shifted << np.uint32(8 * j)
            if 0 < j < size - 1:
                bad[: max(0, n - j)] |= blank[j:]
        inner = blank.copy()
        inner[: max(0, n - 1)] &= blank[1:]
        bad |= inner  # two blanks mark nothing
        hashed = ((code + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_BITS)
        hashed[bad] = BUCKETS
        out.append((hashed.astype(np.int32), size))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # class scores of each feature, a last row of zeros
    bias: np.ndarray
    temperature: float
    reject: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        raw, bounds = text_bytes(column)
        sums = np.zeros((len(column), len(self.languages)))
        counts = np.zeros(len(column))
        for rows, _ in features(raw, bounds):
            for c in range(len(self.languages)):
                run = np.concatenate([[0.0], np.cumsum(self.table[:, c][rows], dtype=np.float64)])
                sums[:, c] += run[bounds[1:]] - run[bounds[:-1]]
            run = np.concatenate([[0], np.cumsum(rows != BUCKETS)])
            counts += run[bounds[1:]] - run[bounds[:-1]]
        logits = sums / np.maximum(counts, 1)[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sample(labelled: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` rows of each language from (doc_id, text, lang): those with the least hash of doc_id, as many of them as have ``SAMPLE_BYTES``
    of text together, or one.

    Only ids and sizes are ranked; Spark cuts the ranking in every partition before the shuffle. The chosen ids are at most ``size``
    per language and may be broadcast. Every language is learned.
    """
    named = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sized = named.select("doc_id", "lang", F.octet_length("text").cast("long").alias("_size"))
    first = sized.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)
    running = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ids = first.withColumn("_sum", running).filter((F.col("_rank") == 1) | (F.col("_sum") <= SAMPLE_BYTES)).select("doc_id", "lang").distinct()
    return named.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])


def train(labelled: DataFrame, size: int = SAMPLE, epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """A model of the languages of (doc_id, text, lang); None when there is nothing to learn from."""

    def counted(batches):
        """Each sampled text as distinct features and counts, so that the driver gets no texts."""
        for batch in pieces(batches, "text"):
            raw, bounds = text_bytes(batch.column(1))
            every = [rows for rows, _ in features(raw, bounds)]
            rows, counts = [], []
            for i in range(batch.num_rows):
                own = np.concatenate([f[bounds[i] : bounds[i + 1]] for f in every])
                at, n = np.unique(own[own != BUCKETS], return_counts=True)
                rows.append(at.astype(np.int32).tobytes())
                counts.append(n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "rows", "counts"])

    got = sample(labelled, size).select("doc_id", "text", "lang").mapInArrow(counted, "doc_id long, lang string, rows binary, counts binary").collect()
    got = sorted((r for r in got if r["rows"]), key=lambda r: (r["doc_id"], r["lang"], r["rows"]))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return None
    examples = [(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.float32), languages.index(r["lang"])) for r in got]
    examples = [(rows, counts / counts.sum(), y) for rows, counts, y in examples]
    random = np.random.default_rng(seed)
    held = set(random.permutation(len(examples))[: len(examples) // 10].tolist())
    fit, check = [e for i, e in enumerate(examples) if i not in held], [examples[i] for i in sorted(held)]

    embedding = random.uniform(-1, 1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    embedding[BUCKETS] = 0
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for k in random.permutation(len(fit)):
            rows, share, y = fit[k]
            rate = RATE * (1 - steps / total) + 0.01
            steps += 1
            mean = share @ embedding[rows]
            error = softmax(mean @ layer + bias)
            error[y] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * error
            embedding[rows] -= rate * 20 * share[:, None] * back  # shares are small: their steps are scaled up
    table = (embedding @ layer).astype(np.float32)
    temperature, reject = calibrated(table, bias, check)
    return Model(languages, table, bias, temperature, reject)


def calibrated(table: np.ndarray, bias: np.ndarray, check: list) -> tuple[float, float]:
    """The temperature of least loss on held-back texts, with a rate-of-succession share of errors, and the rejection score."""
    if not check:
        return 1.0, 0.0
    logits = np.stack([share @ table[rows] + bias for rows, share, _ in check]).astype(np.float64)
    truth = np.array([y for _, _, y in check])
    at = np.arange(len(truth))
    temperatures = np.geomspace(0.05, 20, 60)
    spared = 1 / (len(truth) + 2)  # with no error among n texts, the next one is still right with 1 - 1 / (n + 2) only

    def loss(p):
        own = np.clip(p[at, truth], 1e-12, 1 - 1e-12)
        return -((1 - spared) * np.log(own) + spared * np.log(1 - own)).mean()

    losses = [loss(softmax(logits / t)) for t in temperatures]
    best = float(temperatures[int(np.argmin(losses))])
    p = softmax(logits / best)
    right = p.argmax(1) == truth
    scores = p.max(1)[right]
    return best, min(REJECT_MOST, float(np.quantile(scores, REJECT_SHARE))) if len(scores) else 0.0


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text, ...) with lang_pred, score and accepted (boolean); old columns of these names are replaced.

    A null text, or one without any letter, is ``und`` with score 0 and not accepted; so is every text when nothing was learned. Whole
    texts are read; no other column is an input.
    """
    rest = docs.drop("lang_pred", "score", "accepted")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return rest.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = rest.columns
    text_at = names.index("text")
    marked = rest.withColumn(free_name(rest, "letters"), letters)

    def run(batches):
        own = shared.value
        languages = pa.array(own.languages)
        for batch in pieces(batches, "text"):
            p = own.probabilities(batch.column(text_at))
            known = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            best = languages.take(pa.array(p.argmax(1)))
            lang = pc.if_else(pa.array(known), best, pa.scalar(UNKNOWN))
            score = np.where(known, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [lang, pa.array(score), pa.array(known & (score >= own.reject))], [*names, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return marked.mapInArrow(run, f"{schema}, lang_pred string, score double, accepted boolean")


def held_out() -> Column:
    """Documents that are never learned from: the remainder of crc32(doc_id as text) by 3 is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred, score, accepted (old columns of these names are replaced); learned from rows that are not held out.

    Rows without a doc_id are not held out and not learned from; rows without a lang or text are not learned from; every row gets a prediction
    (see ``predict``), repeated rows each their own, equal texts the same. Languages as likely as each other go to the first in order. Other columns
    stay. An empty table gives an empty table.
    """
    rows = docs.drop("held_out").withColumn("held_out", held_out())
    return predict(rows, train(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang")))
