"""Shared folders, materialised tables and batch helpers for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.tables import fresh_path, materialize, shared_dir

__all__ = ["documents", "fresh_path", "learning_fold", "materialize", "per_step", "quoted", "shared_dir", "shuffle_partitions", "text_steps"]

#: Bytes of text that one step of a Python operator holds as words at a time.
STEP_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quoted(names: list[str]) -> list[str]:
    """Column names as they are written in expressions, dots included."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def learning_fold(key: str, modulus: int) -> F.Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def text_steps(batch: pa.RecordBatch, column: int, step: int = STEP_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Splits a batch into runs of rows with about ``step`` bytes of text: (first row, texts)."""
    values = batch.column(column)
    rows: list[str | None] = []
    first, held = 0, 0
    for i in range(len(values)):
        text = values[i].as_py()
        rows.append(text)
        held += len(text) if text else 0
        if held >= step:
            yield first, rows
            first, rows, held = i + 1, [], 0
    if rows:
        yield first, rows


def per_step(
    make: Callable[[], Callable[[list, list[str | None]], dict]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over (key, text) rows.

    ``make`` runs once for a task and gives a function from the keys and texts of a step to columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for first, texts in text_steps(batch, 1):
                keys = batch.column(0).slice(first, len(texts)).to_pylist()
                out = work(keys, texts)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run
