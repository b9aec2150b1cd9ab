"""Vector best-fit packing of documents into training sequences.

A sequence has three capacities: tokens, documents and attention cost (a piece of n tokens attends within itself,
n * n). Each packing task takes pieces from large to small; for each it looks at every open bin with room under all
three, and takes the one that a rule over the weighted, normalised residual capacities likes best: ``norm`` (the
default) leaves the smallest residual norm, ``dot`` has the largest dot product of piece and residual.

Pieces are dealt to tasks by a hash of their row number into groups of bounded size, whatever their key; the number
of groups grows with the rows, and each group leaves a bin or two that are not full. Full-length pieces need no
search and are sequences of their own. A document is cut only if it is longer than a sequence.

Defined results: a null or empty text is one piece with just the end id; repeated rows are packed as often as they
occur; a text of any length is cut into pieces; null identifiers are kept; extra columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents, materialize, text_steps

#: Pieces that one packing task takes.
GROUP_PIECES = 16_384


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` must each fit in an empty bin."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights = np.array(capacity.weights, np.float64)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if n else 0
    room = np.ones((3, 64), np.float64)  # normalised residuals of the open bins
    ids = np.zeros(64, np.int64)
    opened = made = 0
    filled: list[int] = []
    for step, item in enumerate(order.tolist()):
        length = int(lengths[item])
        need = np.array([length, 1, length * length], np.float64) / full
        if (need > 1 + 1e-12).any():
            raise ValueError(f"a piece of {length} tokens is over the capacity of a bin")
        have = room[:, :opened]
        fits = np.flatnonzero((have[0] >= need[0] - 1e-9) & (have[1] >= need[1] - 1e-9) & (have[2] >= need[2] - 1e-9))
        if len(fits):
            own = have[:, fits]
            if capacity.rule == "dot":
                chosen = int(fits[np.argmax((weights * need) @ own)])
            else:
                chosen = int(fits[np.argmin(weights @ np.square(own - need[:, None]))])
        else:
            if opened == room.shape[1]:
                room = np.concatenate([room, np.ones_like(room)], axis=1)
                ids = np.concatenate([ids, np.zeros_like(ids)])
            chosen, opened = opened, opened + 1
            room[:, chosen], ids[chosen] = 1.0, made
            filled.append(0)
            made += 1
        at = ids[chosen]
        bins[item], offsets[item] = at, filled[at]
        filled[at] += length
        room[:, chosen] -= need
        if step % 128 == 127:  # bins without room for the smallest piece are closed
            keep = np.flatnonzero((room[0, :opened] >= smallest / full[0] - 1e-9) & (room[1, :opened] >= 1 / full[1] - 1e-9))
            if len(keep) < opened:
                room[:, : len(keep)], ids[: len(keep)] = room[:, keep], ids[keep]
                opened = len(keep)
    return bins, offsets


def pieces_of(docs: DataFrame, path: str | None = None, end_id: int = 1, longest: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the end id."""
    path = path or tokens.default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            for first, texts in text_steps(batch, 1):
                rows = []
                for key, text in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts, strict=True):
                    ids = np.append(encode.ids(text), np.array(end_id, encode.dtype)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), longest)):
                        own = ids[start : start + longest]
                        rows.append((key, k, start, len(own), zlib.crc32(own.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: Capacity = Capacity(), end_id: int = 1, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its place there."""
    pieces = materialize(spark, pieces_of(docs, path, end_id, capacity.tokens).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity.tokens)
    rest = pieces.where(F.col("length") < capacity.tokens)
    groups = max(1, -(-rest.count() // group_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), capacity)
        group = table["group"][0].as_py()
        return table.select(names).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    packed = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInArrow(run, out)
    alone = whole.select(*names, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
