"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every token falls into one of ``BUCKETS`` buckets by hash; a bucket has a sparse ternary index vector drawn from a fixed
seed. A bucket's word vector is the sum of the index vectors of its neighbours, one and two places away, over all
documents. Tasks sum up their own matrix and send it in blocks of rows as whole numbers; the sums of all tasks meet by
block in two steps, so the result is the same however the documents are dealt out, and the whole matrix has a fixed size
however large the corpus is. A document is the mean and the spread of its tokens' vectors
and of how well neighbours fit each other. The network has one hidden layer; a temperature fitted on rows that
training did not see calibrates its probabilities.

Word vectors use the texts of all documents and no labels. Labels come from at most ``TRAIN_ROWS`` labelled rows, chosen
by a hash of their identifiers, never from held-out ones; nothing but the text goes into a score.

Defined results: a null or empty text has zero features and a score like any other; a text of any length is pooled in
slices of its tokens; labels that are null or whose
document is missing are left out, repeated ones count as often as they occur; with labels of one kind only, or none, every
score is that kind's share (0.5 without any); repeated rows and null identifiers are kept, and a null identifier is never
held out nor learnt from; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, learning_fold, shuffle_partitions, text_steps

BUCKETS = 8_192
DIMENSIONS = 48
NONZERO = 4
BLOCK_ROWS = 256
#: Parts into which the tasks' matrices are dealt before all parts of a block meet.
SALTS = 64
SEED = 7
#: Most labelled rows that training sees (the bound of the sample).
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
HIDDEN = 32
MAX_FIELDS = 400_000
_RUN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector; the last row is for gaps between texts."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS + 1, DIMENSIONS)), axis=1)[:, :NONZERO].astype(np.int32)
    signs = rng.choice(np.array([-1.0, 1.0]), (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0
    return places, signs


class Buckets(dict):
    """Maps a white-space separated field to its tokens' buckets (bytes of int32)."""

    def __missing__(self, field: bytes) -> bytes:
        if len(self) >= MAX_FIELDS:
            self.clear()
        own = []
        for run in _RUN.findall(field.decode()):
            if run.isdigit():
                run = "0" * min(len(run), 8)
            elif len(run) > 1 and run.isupper():
                own.append("\x00upper")
            own.append(run.lower())
        out = self[field] = np.array([zlib.crc32(t.encode()) % BUCKETS for t in own], np.int32).tobytes()
        return out

    def of(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").encode().split())), np.int32)


_BUCKETS = Buckets()


def context_sums(docs: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors for each bucket."""
    gap = np.array([BUCKETS, BUCKETS], np.int32)
    line = np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap
    out = np.zeros((BUCKETS + 1) * DIMENSIONS)
    for away in (1, 2):
        for center, near in ((line[:-away], line[away:]), (line[away:], line[:-away])):
            base = center.astype(np.int64) * DIMENSIONS
            for j in range(NONZERO):
                out += np.bincount(base + places[near, j], signs[near, j], len(out))
    return out.reshape(BUCKETS + 1, DIMENSIONS)[:BUCKETS]


def packed(sums: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 16, 32 and 64 bits, behind their width."""
    most = int(np.abs(sums).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + sums.astype(f"<i{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(BLOCK_ROWS, DIMENSIONS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The matrix of all buckets' vectors, each of length one (or zero)."""
    shape = "block int, salt int, sums binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for batch in batches:
            for _, texts in text_steps(batch, 0, 4_000_000):
                total += np.rint(context_sums([_BUCKETS.of(t) for t in texts], places, signs)).astype(np.int64)
        blocks = [i for i in range(BUCKETS // BLOCK_ROWS) if total[i * BLOCK_ROWS : (i + 1) * BLOCK_ROWS].any()]
        data = [packed(total[i * BLOCK_ROWS : (i + 1) * BLOCK_ROWS]) for i in blocks]
        own = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([own] * len(blocks), pa.int32()), pa.array(data, pa.binary())], names=["block", "salt", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + unpacked(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array(list(map(packed, sums.values())), pa.binary())], names=["block", "salt", "sums"])

    blocks = BUCKETS // BLOCK_ROWS
    sent = docs.select(F.col("text").cast("string")).mapInArrow(count, shape)
    # in two steps, so that what one task adds up is a share of all tasks' matrices
    parts = sent.repartition(shuffle_partitions(docs.sparkSession), "block", "salt").mapInArrow(add, shape).repartition(blocks, "block").mapInArrow(add, shape)
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    for r in parts.collect():  # BUCKETS x DIMENSIONS numbers in all
        vectors[r["block"] * BLOCK_ROWS : (r["block"] + 1) * BLOCK_ROWS] = unpacked(r["sums"])
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


FEATURES = 2 * DIMENSIONS + 4


def pooled(buckets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' vectors, their neighbours' fit, the share of distinct tokens, and log length."""
    out = np.zeros(FEATURES, np.float32)
    n = len(buckets)
    if not n:
        return out
    total, squares, fit, spread = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    for at in range(0, n, 65_536):
        own = vectors[buckets[at : at + 65_537]]
        here = own[:65_536]
        total += here.sum(axis=0)
        squares += np.einsum("ij,ij->j", here, here)
        if len(own) > 1:
            near = np.einsum("ij,ij->i", own[:-1], own[1:])
            fit += float(near.sum())
            spread += float(np.square(near).sum())
    mean = total / n
    pairs = max(n - 1, 1)
    out[:DIMENSIONS] = mean
    out[DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(squares / n - mean**2, 0))
    out[2 * DIMENSIONS :] = fit / pairs, np.sqrt(max(spread / pairs - (fit / pairs) ** 2, 0)), len(np.unique(buckets)) / n, np.log1p(n) / 10
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, one output, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def constant(share: float, width: int = FEATURES) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on nine tenths of the rows; the best epoch and the temperature are chosen on the others."""
    if len(y) < 2 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1] if x.ndim == 2 else FEATURES)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    aside = order[: max(1, len(y) // 10)]
    used = order[len(aside) :] if len(order) > len(aside) else order
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-4
    z = (x - mean) / scale
    values = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    best, best_loss, step = [v.copy() for v in values], np.inf, 0
    for epoch in range(epochs):
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        shuffled = rng.permutation(used)
        for at in range(0, len(shuffled), batch):
            rows = shuffled[at : at + batch]
            hidden = np.maximum(z[rows] @ values[0] + values[1], 0)
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3][0], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(wrong, values[2]) * (hidden > 0)
            slopes = [z[rows].T @ back + decay * values[0], back.sum(axis=0), hidden.T @ wrong + decay * values[2], np.array([wrong.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                values[i] -= now * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        loss = _loss(np.maximum(z[aside] @ values[0] + values[1], 0) @ values[2] + values[3][0], y[aside])
        if loss < best_loss:
            best, best_loss = [v.copy() for v in values], loss
    net = Network(mean, scale, best[0], best[1], best[2], float(best[3][0]))
    logits = net.logits(x[aside])
    net.temperature = min((0.05 * k for k in range(8, 101)), key=lambda t: _loss(logits / t, y[aside]))
    return net


def features(rows: DataFrame, vectors: np.ndarray, extra: str = "") -> DataFrame:
    """(key, features as bytes of float32); ``rows`` has a key and a text."""
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_steps(batch, 1):
                data = [pooled(_BUCKETS.of(t), shared.value).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(data, pa.binary())], names=["key", "features"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, features binary")


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, text) of at most TRAIN_ROWS labelled rows outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    usable = usable.where(learning_fold("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "quality").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS rows of twelve bytes
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(usable), "doc_id").select("quality", "text")


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    vectors = word_vectors(docs)
    sample = features(labelled_sample(docs, labels), vectors).collect()  # at most TRAIN_ROWS rows, repeats aside
    x = np.array([np.frombuffer(r["features"], np.float32) for r in sample], np.float64).reshape(-1, FEATURES)
    y = np.array([1.0 if r["key"] > 0 else 0.0 for r in sample])
    order = np.lexsort((*x.T[:4], y))  # the same order in every run
    shared = spark.sparkContext.broadcast((vectors, train(x[order], y[order])))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, net = shared.value
        for batch in batches:
            for first, texts in text_steps(batch, 1):
                score = net.score(np.array([pooled(_BUCKETS.of(t), own) for t in texts], np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(np.round(score, 9))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(learning_fold("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
