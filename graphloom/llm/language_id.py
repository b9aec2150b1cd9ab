"""Language identification by rank-order n-gram profiles.

A profile is the ``PROFILE`` most frequent character n-grams (one to three letters, words padded with a space) in
order. A document's own profile is compared with each language's by the out-of-place distance: the sum of the differences
of ranks, with ``PROFILE`` for an n-gram that the language's profile lacks. The nearest language wins.

An n-gram is one number of three code points, so a text's n-grams are counted by sorting an array. Profiles are counted
over all learning documents: each task has n-gram counts of its own, and these sums meet by language and n-gram, so
no language is ever one task's rows. Profiles are ``PROFILE`` rows for each language.

Defined results: a null text, or one without letters, is ``und`` with score 0; of equal counts longer n-grams come first,
then those of smaller code points, and of equal distances the first language; without learning documents all is
``und``, and the pipeline's stage keeps every document with a letter; a text of any length is counted in slices of
``SLICE`` characters; repeated rows and null identifiers are kept, and a null identifier is never held out nor learnt
from; extra columns are ignored, whatever their names; no rows give no rows. The score is one minus the distance over
its greatest value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, learning_fold, quoted, text_steps

PROFILE = 400
LONGEST = 3
UNKNOWN = "und"
#: Share of a language's median score under which the pipeline takes a text for another language or none.
TYPICAL = 0.6
#: N-grams that a task holds before it sums them up again.
HELD_GRAMS = 3_000_000
#: Characters of a text that are arrays at a time.
SLICE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: Bits of a code point, and what stands before shorter n-grams: no code point.
_BITS, _NONE = 21, (1 << 21) - 1


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    out = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        out[[ord(c) for c in _LETTER.findall("".join(map(chr, range(low, high))))]] = True
    return out


def keys_of(text: str | None) -> Iterator[np.ndarray]:
    """The n-grams of a text's words as numbers, by slices; what is no letter is zero, which pads words."""
    low = (text or "").lower()
    for at in range(0, len(low), SLICE):
        # one character more on either side: a slice has the n-grams that end or have their middle in it
        part = low[max(at - 1, 0) : at + SLICE + 1]
        codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        before = int(at > 0)
        n = min(SLICE, len(low) - at)
        c = np.zeros(n + 2, np.int64)
        c[1 - before : 1 - before + len(codes)] = np.where(_letters()[codes], codes, 0)
        here = c[1:-1] != 0
        two = (c[:-2] << _BITS | c[1:-1])[(c[:-2] != 0) | here]
        if at + SLICE >= len(low) and here[-1]:  # the last letter and the end
            two = np.append(two, c[-2] << _BITS)
        three = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[here]
        yield np.concatenate([c[1:-1][here] + (_NONE << 2 * _BITS | _NONE << _BITS), two + (_NONE << 2 * _BITS), three])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, sorted, and how often each stands there."""
    parts = [np.unique(k, return_counts=True) for k in keys_of(text)]
    return parts[0] if len(parts) == 1 else _summed(parts)


def gram_of(key: int) -> str:
    parts = [key >> 2 * _BITS, key >> _BITS & _NONE, key & _NONE]
    return "".join(chr(p) if p else " " for p in parts if p != _NONE)


def key_of(gram: str) -> int:
    parts = [_NONE] * (LONGEST - len(gram)) + [0 if c == " " else ord(c) for c in gram]
    return parts[0] << 2 * _BITS | parts[1] << _BITS | parts[2]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) of the languages in ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def send() -> pa.RecordBatch:
            rows = [(lang, gram_of(k), n) for lang, parts in held.items() for k, n in zip(*(x.tolist() for x in _summed(parts)), strict=True)]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.string()), pa.array(list(columns[2]), pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for first, texts in text_steps(batch, 1):
                own: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts, strict=True):
                    for keys in keys_of(text):
                        own.setdefault(lang, []).append(keys)
                        if len(keys) > SLICE:
                            held.setdefault(lang, []).append(np.unique(np.concatenate(own.pop(lang)), return_counts=True))
                for lang, parts in own.items():
                    held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
                if sum(len(k) for parts in held.values() for k, _ in parts) > HELD_GRAMS:
                    yield send()
        yield send()

    sent = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, gram string, n bigint")
    summed = sent.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), F.desc(F.length("gram")), "gram"))
    # a plain limit on the row number: each task keeps its first rows of a language before they are dealt out
    return summed.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Ranker:
    """Compares documents with the profiles of languages."""

    def __init__(self, learnt: list[tuple[str, str, int]], size: int = PROFILE) -> None:
        self.size = size
        self.languages = sorted({lang for lang, _, _ in learnt})
        self.known = np.unique(np.array([key_of(g) for _, g, _ in learnt], np.int64))
        self.ranks = np.full((len(self.languages), len(self.known) + 1), size, np.int64)  # the last is for all others
        for lang, gram, rank in learnt:
            self.ranks[self.languages.index(lang), np.searchsorted(self.known, key_of(gram))] = rank

    def rank(self, text: str | None) -> tuple[str, float]:
        keys, counts = counted(text)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        if len(keys) > self.size:  # all that may be among the first, ties included
            least = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            keys, counts = keys[counts >= least], counts[counts >= least]
        top = keys[np.argsort(-counts, kind="stable")][: self.size]
        at = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
        profile = self.ranks[:, np.where(self.known[at] == top, at, len(self.known))]
        away = np.where(profile == self.size, self.size, np.abs(profile - np.arange(len(top)))).sum(axis=1)
        best = int(away.argmin())
        return self.languages[best], 1.0 - float(away[best]) / (self.size * len(top))


def learn(learning: DataFrame) -> list[tuple[str, str, int]]:
    return [(r["lang"], r["gram"], r["rank"]) for r in profiles(learning).collect()]  # PROFILE rows a language


def identified(spark: SparkSession, docs: DataFrame, learning: DataFrame, keep: list[str] | None = None, learnt: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` of every document, beside its columns ``keep`` (doc_id)."""
    learnt = learn(learning) if learnt is None else learnt
    shared = spark.sparkContext.broadcast(learnt)
    rows = docs.select(F.struct(*quoted(keep or ["doc_id"])).alias("row"), F.col("text").cast("string").alias("text"))
    names = ["row", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ranker(shared.value)
        for batch in batches:
            for first, texts in text_steps(batch, 1):
                lang, score = zip(*map(own.rank, texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(lang, pa.string()), pa.array(np.round(score, 9))], names=names)

    shape = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, shape)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (learning_fold("doc_id", 3) != 1)).select("lang", "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identified(spark, docs.select("doc_id", "text"), learning_rows(docs))
    held_out = F.coalesce(learning_fold("doc_id", 3) == 1, F.lit(False))
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def least_scores(spark: SparkSession, learning: DataFrame, learnt: list[tuple[str, str, int]]) -> dict[str, float]:
    """For each language ``TYPICAL`` of the median score of all its learning documents."""
    own = identified(spark, learning, learning, ["lang"], learnt).where("row.lang = lang_pred")
    return {r["lang_pred"]: TYPICAL * r["m"] for r in own.groupBy("lang_pred").agg(F.percentile_approx("score", 0.5, 10_000).alias("m")).collect()}  # one row a language


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a learnt language, with their own columns; those without letters or far from every profile go.

    Where nothing could be learnt no language is known to be wrong, so only documents without letters go.
    """
    learning = learning_rows(docs)
    learnt = learn(learning)
    if not learnt:
        return docs.where(F.col("text").cast("string").rlike("\\p{L}"))
    least = F.lit(0.0)
    for lang, score in least_scores(spark, learning, learnt).items():
        least = F.when(F.col("lang_pred") == lang, score).otherwise(least)
    return identified(spark, docs, learning, docs.columns, learnt).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
