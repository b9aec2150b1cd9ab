"""The pipeline's dedup stage: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Two fingerprints of 64 bits tell copies apart from texts with some changed words, but not those of similarity 0.8 from
others: they differ in about ten bits, give or take three, and no exact search within so many bits is selective. So
candidates come from two sources: groups of the SimHash operator (fingerprints of five-word shingles, links by
bit-sliced comparison), and ``BANDS`` bands of ``ROWS`` minima of the shingles' hashes: two texts of similarity 0.8
share no band in 7 of 10,000 cases, nearer ones far less often. Every candidate is then decided by the exact similarity
of its shingles, so none goes by an estimate.

Members of a group or band are compared with leaders, not with each other: in each round some members (one, then four,
16 ...) are compared with all others, then they and what went leave, until no group has two members left. A leader
is a member whose groups are the largest, as the middle of a cluster of copies is; of two near copies the one that is
less so, or has the greater identifier, goes. So no two texts that stay and share a group are near copies, a group of
n copies costs n comparisons, and no group is one task's rows.

Equal texts count once, and the smallest identifier stands for them; a null one comes last.

Texts are not dealt out to find the few that matter. Bloom filters of keys, at most ``FILTER_WORDS`` words that are sent
to all executors, say which texts may be compared, and which rows may go or have equals. A row that passes no such filter
stays where it is. What stays but passes (by chance, or as it has equals) is known from the table of keys; a second
filter finds these rows, which are dealt out and decided by their keys, and the others that passed go. A full filter
lets more rows through and changes no result. Nothing but counts and emptiness tests comes to the driver, beside the
filters' words on their way.

Defined results: a null text is empty, and all texts without words are equal or near copies; a shorter text than five
words is one shingle; a text of any length is a set of 8 bytes a word; unlike texts under one identifier, or under none,
all stay, and of rows with equal identifier and text one stays, chosen by a hash of its columns; extra columns are kept,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, per_step, quoted

WORDS = 5
#: The least similarity, as a ratio.
LEAST = (4, 5)
BANDS, ROWS = 40, 8
SEED = 42
#: Values of shingles that are multiplied at a time.
STEP = 256
#: Bits of a filter for each key, those set in the key's word of 64, and the most words of a filter.
FILTER_BITS, PROBES, FILTER_WORDS = 16, 4, 2**20
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def runs_of(text: str | None) -> np.ndarray:
    """Hashes of the runs of ``WORDS`` words, in order and with repeats; a shorter text is one run."""
    hashed = xxhash.xxh64_intdigest
    parts = [np.array([hashed(w, SEED) for w in words], np.uint64) for words in simhash.word_slices(text)]
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = min(WORDS, len(h))
    runs = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        runs = (runs ^ runs >> np.uint64(29)) * _MIX + h[i : len(h) - n + 1 + i]
    return (runs ^ runs >> np.uint64(32)) * _MIX


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct runs, sorted."""
    return np.unique(runs_of(text))


def bands_of(own: np.ndarray) -> list[int]:
    """Signed hashes of the bands of a set of shingles; all texts without words share one."""
    if not len(own):
        return [0]
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), STEP):
        np.minimum(low, (own[at : at + STEP, None] * _FACTORS).min(axis=0), out=low)
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], np.uint64).view(np.int64).tolist()


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def key_of() -> F.Column:
    """What tells rows of different identifier or text apart: (nameless, doc_id, h); null identifiers come last."""
    doc_id = F.col("doc_id").cast("bigint")
    return F.struct(doc_id.isNull().cast("int").alias("nameless"), F.coalesce(doc_id, F.lit(0).cast("bigint")).alias("doc_id"), text_hash().alias("h"))


def sketches(docs: DataFrame) -> DataFrame:
    """(nameless, doc_id, h, digest, size, fp, bands) of every row."""
    names = ["nameless", "doc_id", "h", "digest"]

    def print_of(runs: np.ndarray) -> int:
        votes = simhash.Votes()
        votes.add(runs)
        return votes.fingerprint() if len(runs) else 0

    def make():
        def work(keys: list, texts: list) -> dict:
            runs = [runs_of(t) for t in texts]
            sets = [np.unique(r) for r in runs]
            own = {"size": [len(s) for s in sets], "fp": np.array([print_of(r) for r in runs], np.uint64).view(np.int64), "bands": [bands_of(s) for s in sets]}
            return {**{c: [k[c] for k in keys] for c in names}, **own}

        return work

    schema = pa.schema([("nameless", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = key_of().withField("digest", F.md5(text.cast("binary")))
    shape = "nameless int, doc_id bigint, h bigint, digest string, size bigint, fp bigint, bands array<bigint>"
    return docs.select(key.alias("key"), text.alias("text")).mapInArrow(per_step(make, schema), shape)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text of a, text of b, b); b of those that are near copies. Neighbouring rows often have the same a."""
    held: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            text = batch.column(0)[i].as_py()
            if text != held[0]:
                held = (text, shingles(text))
            if near(held[1], shingles(batch.column(1)[i].as_py())):
                found.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(found, pa.int64()))], names=["me"])


def filter_of(spark: SparkSession, keys: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """Joins rows (a column me) by ``left_semi`` or ``left_anti`` with a filter of ``keys`` (me), without moving them.

    All rows whose key is among ``keys`` pass the first and some others; the second gives the rest.
    """
    words = max(1, min(FILTER_WORDS, -(-keys.count() * FILTER_BITS // 64)))
    h = F.xxhash64("me")
    word = F.pmod(F.shiftrightunsigned(h, 6 * PROBES), F.lit(words).cast("bigint"))
    places = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int") for i in range(PROBES)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in places])
    found = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    found = F.broadcast(materialize(spark, found, "filter"))
    return lambda rows, how: rows.join(found, (word == F.col("word")) & (F.col("bits").bitwiseAND(mask) == mask), how)


def _crowded(rows: DataFrame) -> DataFrame:
    """The rows of bands that have two members or more."""
    return rows.join(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band", "left_semi")


def candidates(spark: SparkSession, contents: DataFrame) -> DataFrame:
    """(band, me, size, standing) of all that share a band or a SimHash group; the largest crowds have the least standing."""
    root = simhash.groups(spark, contents.select("fp"))
    grouped = contents.join(root, "fp").select("me", "size", F.xxhash64("root", F.lit("simhash")).alias("band"))
    rows = contents.select("me", "size", F.explode("bands").alias("band")).unionByName(grouped)
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(spark, rows.join(sizes, "band"), "band_members")
    standing = rows.groupBy("me").agg((-F.sum("n")).alias("standing"))
    return materialize(spark, rows.join(standing, "me").select("band", "me", "size", "standing"), "bands")


def gone(spark: SparkSession, docs: DataFrame, contents: DataFrame) -> DataFrame:
    """The texts (me) of ``contents`` (me: the key's struct; size, fp, bands) that are near copies of one that goes before."""
    rows = candidates(spark, contents)
    went, texts, leaders = None, None, 1
    while not rows.isEmpty():
        if texts is None:
            own = docs.select(key_of().alias("me"), F.col("text").cast("string").alias("text"))
            wanted = materialize(spark, rows.select("me").distinct(), "candidates")
            own = filter_of(spark, wanted)(own, "left_semi").groupBy("me").agg(F.first("text").alias("text"))
            texts = materialize(spark, own, "candidate_texts")
        place = F.struct("standing", "me")
        lead = rows.groupBy("band", F.pmod("me.h", F.lit(leaders)).alias("sub")).agg(F.min(F.struct(place.alias("place"), "size")).alias("lead"))
        lead = materialize(spark, lead.select("band", "lead.place", "lead.size").toDF("band", "other", "other_size"), "leaders")
        alike = LEAST[1] * F.least("size", "other_size") >= LEAST[0] * F.greatest("size", "other_size")
        pairs = rows.withColumn("place", place).join(lead, "band").where((F.col("place") != F.col("other")) & alike)
        pairs = pairs.select(F.least("place", "other")["me"].alias("a"), F.greatest("place", "other")["me"].alias("b")).distinct()
        pairs = materialize(spark, pairs, "pairs")
        members = pairs.select(F.col("a").alias("me")).distinct().unionByName(pairs.select(F.col("b").alias("me")).distinct())
        asked = filter_of(spark, members)(texts, "left_semi")
        later = pairs.join(asked.toDF("b", "text_b"), "b")
        both = later.join(asked.toDF("a", "text_a"), "a")
        found = materialize(spark, both.select("text_a", "text_b", F.col("b").alias("me")).mapInArrow(_near_pairs, contents.select("me").schema).distinct(), "near_copies")
        went = found if went is None else went.unionByName(found)
        rest = rows.join(lead.select("band", F.col("other.me").alias("me")), ["band", "me"], "left_anti").join(found, "me", "left_anti")
        rows = materialize(spark, _crowded(rest), "bands")
        leaders *= 4
    return contents.select("me").limit(0) if went is None else went.distinct()


def decided(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(me, n, stays) of the texts, by identifier: how many equal rows each has, and whether it stays."""
    found = materialize(spark, sketches(docs), "sketches")
    me = F.struct("nameless", "doc_id", "h")
    contents = found.groupBy("digest").agg(F.min(me).alias("me"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    contents = materialize(spark, contents.drop("digest"), "distinct_texts")
    stay = contents.select("me").join(gone(spark, docs, contents), "me", "left_anti").withColumn("stays", F.lit(True))
    times = found.groupBy(me.alias("me")).agg(F.count("*").alias("n"))
    return materialize(spark, times.join(stay, "me", "left").select("me", "n", F.coalesce("stays", F.lit(False)).alias("stays")), "decided")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near copies by five-word shingles; of rows with equal identifier and text, one stays."""
    keys = decided(spark, docs)
    names = quoted(docs.columns)
    rows = docs.select(key_of().alias("me"), F.struct(*names).alias("row"))
    touched = filter_of(spark, keys.where("n > 1 or not stays").select("me"))
    again = materialize(spark, touched(keys.where("stays").select("me"), "left_semi"), "passing_keys")
    maybe = filter_of(spark, again)(touched(rows, "left_semi"), "left_semi")
    # rows of one key become one before they are dealt out, so a key of many rows is no task's load
    one = maybe.groupBy("me").agg(F.min_by("row", F.xxhash64(*[f"row.{n}" for n in names])).alias("row"))
    kept = one.join(again, "me", "left_semi").select("me", "row")
    return touched(rows, "left_anti").unionByName(kept).select("row.*")
