"""SimHash near-duplicates: exact search of fingerprints within a radius, by bit-sliced comparison.

Every distinct fingerprint is dealt out by each pair of its four 16-bit quarters: two that differ in at most two bits
agree on at least two quarters, so they meet under some key. Where a key has more fingerprints than
``GROUP_LIMIT``, its members are dealt out once more, by each third of their other 32 bits (they agree on at least one
whole third), so hot groups shrink and no link is lost. Within a group the fingerprints stand as vertical bit
planes; queries are compared with 64 of them in one word, a carry-save counter of two planes adds the differing bits,
and a block is left as soon as all its counters are over the radius. A group reports a forest, at most one link for
each member, never all its pairs. Links are then joined by the large-star and small-star steps.

Equal fingerprints count once, so groups of copies cost one member. Nothing but counts comes to the driver.

Defined results: a null or empty text has fingerprint zero; a text of any length is hashed in slices of ``SLICE``
bytes; documents with null identifiers keep their rows and take part by fingerprint; repeated rows are kept; extra
columns are ignored, whatever their names; no rows give no rows. If a component has no identifier at all its
component_id is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, per_step

RADIUS = 2
SHINGLE = 3
SEED = 42
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Members of a group that one task compares without dealing them out again.
GROUP_LIMIT = 8_192
#: Bytes of a text that are words at a time.
SLICE = 4_000_000
#: Queries compared at a time.
QUERIES = 512
QUARTERS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: First bit and bits of the thirds of 32 bits.
THIRDS = [(0, 11), (11, 11), (22, 10)]


class Votes:
    """How many hashes have each bit set, of all that were added."""

    def __init__(self) -> None:
        self.ones, self.n = np.zeros(64, np.int64), 0

    def add(self, h: np.ndarray) -> None:
        self.n += len(h)
        for at in range(0, len(h), 65_536):
            part = np.ascontiguousarray(h[at : at + 65_536], "<u8")
            self.ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    def fingerprint(self) -> int:
        """The bits that are set in more than half."""
        return int(np.packbits(2 * self.ones > self.n, bitorder="little").view("<u8")[0])


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time. Only A-Z are lowered and only ASCII white space splits, as these are bytes."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + SLICE) if at + SLICE < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    n, votes, words = words_per_shingle, Votes(), []
    hashed = xxhash.xxh64_intdigest
    for part in word_slices(text):
        words += part
        if len(words) >= n:
            runs = [words[i : len(words) - n + 1 + i] for i in range(n)]
            votes.add(np.array([hashed(s, SEED) for s in map(b" ".join, zip(*runs, strict=True))], "<u8"))
            words = words[len(words) - n + 1 :]
    if words and not votes.n:
        votes.add(np.array([hashed(b" ".join(words), SEED)], "<u8"))
    return votes.fingerprint() if votes.n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp); fp is the fingerprint as a signed long."""

    def make():
        def work(keys: list, texts: list) -> dict:
            return {"doc_id": keys, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(per_step(make, schema), "doc_id bigint, fp bigint")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 planes of one bit for each value, 64 values in a word; values that fill up the last word are zero."""
    n = len(values)
    padded = np.zeros(-(-n // 64) * 64, "<u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, value) places of all pairs that differ in at most ``radius`` (0 to 2) bits."""
    words = planes.shape[1]
    ones = np.zeros((len(queries), words), "<u8")
    twos, over = np.zeros_like(ones), np.zeros_like(ones)
    for bit in range(64):
        flip = np.where(queries >> np.uint64(bit) & np.uint64(1), np.uint64(2**64 - 1), np.uint64(0))
        differ = planes[bit][None, :] ^ flip[:, None]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if bit & 7 == 7 and (over | (ones & twos)).min() == np.uint64(2**64 - 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = over | (ones & twos)
    if radius < 2:
        far |= twos
    if radius < 1:
        far |= ones
    near = np.unpackbits(np.ascontiguousarray(~far).view(np.uint8), axis=1, bitorder="little")[:, :n]
    return np.nonzero(near)


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius, directly or over others: each value to the root of its tree."""
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    block = 4_096
    planes = [(at, min(block, n - at), planes_of(values[at : at + block])) for at in range(0, n, block)]
    for q in range(0, n, QUERIES):
        asked = values[q : q + QUERIES]
        for at, m, own in planes:
            if at + m <= q:
                continue  # these pairs have met
            a, b = within(own, m, asked, radius)
            a, b = a + q, b + at
            for i, j in zip(a[a < b].tolist(), b[a < b].tolist(), strict=True):
                i, j = root(i), root(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
    roots = np.array([root(i) for i in range(n)])
    linked = np.flatnonzero(roots != np.arange(n))
    return values[linked], values[roots[linked]]


def _links_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key columns ..., fp) sorted by key; a group is complete when the key changes."""
    held_key: tuple | None = None
    held: list[np.ndarray] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        values = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        if len(values) > 1:
            found.append(forest(values))

    def flush() -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
        fps = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
        changed = np.zeros(len(fps), bool)
        changed[0] = True
        for k in keys:
            changed[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(changed)
        ends = np.append(starts[1:], len(fps))
        first = tuple(k[0] for k in keys)
        if held_key is not None and held_key != first:
            close()
            held = []
        for s, e in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):  # all but the last group end here
            if held:
                held.append(fps[s:e])
                close()
                held = []
            elif e - s > 1:
                values = np.unique(fps[s:e])
                if len(values) > 1:
                    found.append(forest(values))
        held.append(fps[starts[-1] : ends[-1]].copy())
        held_key = tuple(k[-1] for k in keys)
        if len(found) > 10_000:
            yield flush()
    close()
    yield flush()


def _bits(column: str, first: int, n: int) -> F.Column:
    return F.shiftrightunsigned(F.col(column), first).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def links(spark: SparkSession, distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within the radius; ``distinct`` has one column fp."""
    quarters = [F.struct(F.lit(i).alias("pair"), (F.shiftleft(_bits("fp", 16 * x, 16), 16).bitwiseOR(_bits("fp", 16 * y, 16))).alias("key")) for i, (x, y) in enumerate(QUARTERS)]
    keyed = distinct.select("fp", F.explode(F.array(*quarters)).alias("k")).select("k.pair", "k.key", "fp")
    crowded = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    hot = materialize(spark, crowded.where(F.col("n") > group_limit).select("pair", "key"), "hot_keys")
    shape = "a bigint, b bigint"
    plain = keyed if not hot.take(1) else keyed.join(hot, ["pair", "key"], "left_anti")
    out = plain.repartition("pair", "key").sortWithinPartitions("pair", "key").select("pair", "key", "fp").mapInArrow(_links_in_groups, shape)
    if hot.take(1):
        rest = F.element_at(F.array(*[F.shiftleft(_bits("fp", 16 * x, 16), 16).bitwiseOR(_bits("fp", 16 * y, 16)) for x, y in [(2, 3), (1, 3), (1, 2), (0, 3), (0, 2), (0, 1)]]), F.col("pair") + 1)
        again = keyed.join(hot, ["pair", "key"], "left_semi").withColumn("rest", rest)
        thirds = F.array(*[F.struct(F.lit(i).alias("third"), _bits("rest", at, n).alias("sub")) for i, (at, n) in enumerate(THIRDS)])
        again = again.select("pair", "key", F.explode(thirds).alias("t"), "fp").select("pair", "key", "t.third", "t.sub", "fp")
        out = out.unionByName(again.repartition("pair", "key", "third", "sub").sortWithinPartitions("pair", "key", "third", "sub").mapInArrow(_links_in_groups, shape))
    return out.distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    Large-star and small-star in turn until nothing changes; each round is a written table.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = materialize(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if not current.take(1):
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def least_of(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    mark = None
    for _ in range(rounds):
        wide = both(current)
        large = wide.join(least_of(wide), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lows = least_of(small)
        joined = small.join(lows, "a")
        current = materialize(spark, joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError("the components did not settle")


def groups(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint in ``prints``; root is the smallest of its component."""
    distinct = prints.select("fp").distinct()
    roots = components(spark, links(spark, distinct))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = materialize(spark, fingerprints(docs), "fingerprints")
    firsts = materialize(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    tree = materialize(spark, firsts.join(groups(spark, firsts), "fp"), "trees")
    least = tree.groupBy("root").agg(F.min("first").alias("component_id"))
    members = tree.join(least, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
