"""Quality rules in DataFrame functions only: base counts, then a hashed n-gram log-likelihood ratio.

Words are runs without ASCII white space. Each word and each pair of neighbouring words falls into one of
``BUCKETS`` buckets by hash. Two multinomials over the buckets, one of a trusted target and one of the raw corpus,
are counted over all documents; a document's score is the mean over its n-grams of the log of their ratio, so
length doesn't count. No draw is made, so every run decides alike.

The cut is relative: a document's group (by default its ``lang``, hashed to one of ``GROUPS`` numbers) has the median
score of its trusted documents, taken over all of them, and a document is kept if no base rule fails and its score is
at least that median less ``MARGIN``. So a language or source mix whose scores shift as one keeps its documents. A
group without trusted documents has the median over all trusted ones.

Every text is measured once: the base columns and the buckets, as small integers, are a written table, from which the
multinomials, the medians and the scores come. Counting is an explode with partial sums, so no key is ever hot. What
comes to the driver is one pair of counts for each bucket and one median for each group, however large the corpus.

The trusted target is by default what passes the strict form of the rules (``trusted``), repeated lines and words in
proportion to all; callers can give any condition over the columns of ``measured``, and any column as group.

Defined results: a null or empty text has no words, so it fails the base rules, with score 0; a text of any length is
one row and its arrays of hashes, about 100 bytes a word, are in memory at once; repeated rows and null identifiers
are kept; a null or missing group is one group; extra columns are ignored, whatever their names; no rows give no rows;
with no trusted document all scores and medians are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, quoted

BUCKETS = 8_192
GROUPS = 1_024
#: How far under the median of its group's trusted documents a score may be, as a mean log ratio: n-grams that are
#: seven in a hundred rarer in the target, against the raw corpus, than those of the middle trusted document.
MARGIN = 0.07
SMOOTHING = 1.0
#: Scores are counted in steps of one over this for the medians.
STEPS = 10_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: White space and symbols of the rules (fixed values).
SPACE = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, pattern: str) -> Column:
    """How many one-byte characters of a class there are."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("bigint")).cast("smallint")  # BUCKETS is a power of two


def _neighbours(values: Column, n: Column, hashed: Callable[[Column, Column], Column], other: Column, ahead: int) -> Column:
    """``hashed`` of each of the first ``n`` values and the other value that is ``ahead`` places later."""
    none = F.array().cast("array<bigint>")
    return F.when(n > 0, F.zip_with(F.slice(values, F.lit(1), n), F.slice(other, F.lit(1 + ahead), n), hashed)).otherwise(none)


def _spread(places: Column) -> Column:
    """Words that windows of three at these sorted places cover."""
    n = F.size(places)
    gaps = F.zip_with(F.slice(places, F.lit(2), n - 1), F.slice(places, F.lit(1), n - 1), lambda b, a: F.least(F.lit(3), b - a))
    return F.when(n > 0, F.aggregate(gaps, F.lit(3).cast("bigint"), lambda a, g: a + g)).otherwise(F.lit(0).cast("bigint"))


def measured(docs: DataFrame, keep: list[str] | None = None, group: Column | None = None) -> DataFrame:
    """Columns of the rules, ``group`` and ``buckets`` of every document, beside the columns ``keep`` (doc_id) in ``row``.

    Each step's arrays are columns that the next step uses more than once, so that they are made once and sorting and
    comparing them is compiled code.
    """
    named = docs.select(
        F.struct(*quoted(keep or ["doc_id"])).alias("row"),
        F.pmod(F.xxhash64(F.lit("") if group is None else group.cast("string")), F.lit(GROUPS)).cast("int").alias("group"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = named.select("*", F.array_remove(F.split("text", GAP), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0).alias("lines"))
    hashed = words.select(
        "row",
        "group",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("text"), "[A-Z]").alias("n_upper"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("one"),
    )
    both = lambda a, b: F.xxhash64(a, b)
    two = hashed.select("*", _neighbours(F.col("one"), F.size("one") - 1, both, F.col("one"), 1).alias("two"))
    three = two.select("*", _neighbours(F.col("two"), F.size("two") - 1, both, F.col("one"), 2).alias("three"))
    window = F.arrays_zip(F.col("three").alias("h"), F.sequence(F.lit(0), F.size("three") - 1).alias("i"))
    ordered = three.select("*", F.when(F.size(F.array_distinct("three")) < F.size("three"), F.sort_array(window)).alias("ordered"))
    pairs = F.arrays_zip(F.slice("ordered", F.lit(1), F.size("ordered") - 1).alias("a"), F.slice("ordered", F.lit(2), F.size("ordered") - 1).alias("b"))
    again = ordered.select("*", F.when(F.col("ordered").isNotNull(), F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])).alias("again"))
    found = F.array_distinct(F.concat(F.transform("again", lambda p: p["a"]["i"]), F.transform("again", lambda p: p["b"]["i"])))
    places = again.select("*", F.when(F.col("again").isNotNull(), F.sort_array(found)).otherwise(F.array().cast("array<int>")).alias("places"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    grams = F.concat(F.transform("one", _bucket), F.transform("two", _bucket))
    return places.select("row", "group", *BASE[:-1], "n_upper", "n_lines", _spread(F.col("places")).alias("n_repeat_words"), grams.alias("buckets")).withColumn("base_failed", failed)


def trusted() -> Column:
    """The strict form of the rules: none fails, hardly any symbols or capitals, at most a tenth of lines or words repeated."""
    few = (200 * F.col("n_symbols") <= F.col("word_chars")) & (10 * F.col("n_upper") <= F.col("word_chars"))
    return ~F.col("base_failed") & few & (10 * F.col("n_dup_lines") <= F.col("n_lines")) & (10 * F.col("n_repeat_words") <= F.col("n_words"))


def log_ratios(rows: DataFrame, target: Column) -> list[float]:
    """For each bucket the smoothed log ratio of its share in the target to that in the raw corpus."""
    counts = (
        rows.select(target.cast("bigint").alias("in_target"), F.explode("buckets").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("in_target").alias("target"))
        .collect()  # at most BUCKETS rows
    )
    raw, aim = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        aim[r["bucket"]] += r["target"]
    if sum(aim) == SMOOTHING * BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw) / sum(aim))
    return [math.log(a / r) + shift for a, r in zip(aim, raw, strict=True)]


def _table(values: list[float], form: str) -> Column:
    """An array that is one constant."""
    return F.split(F.lit(",".join(format(x, form) for x in values)), ",").cast("array<double>")


def medians(scored: DataFrame, target: Column) -> list[float]:
    """For each group the median score of its documents in the target, to one over ``STEPS``; that of all where it has none."""
    bins = scored.where(target).groupBy("group", F.round(F.col("score") * STEPS).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    every = bins.unionByName(bins.select(F.lit(-1).alias("group"), "bin", "n")).groupBy("group", "bin").agg(F.sum("n").alias("n"))
    # two sums over bins, which are at most some thousands a group however many documents there are
    below = every.select("group", "bin", F.expr("sum(n) over (partition by group order by bin)").alias("below"), F.expr("sum(n) over (partition by group)").alias("all"))
    found = {r["group"]: r["bin"] / STEPS for r in below.where("2 * below >= all").groupBy("group").agg(F.min("bin").alias("bin")).collect()}  # one row a group
    return [found.get(g, found.get(-1, 0.0)) for g in range(GROUPS)]


def judged(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None, target: Column | None = None, group: Column | None = None, margin: float = MARGIN) -> DataFrame:
    """Base columns, ``score``, ``cut`` and ``kept`` of every document, and its ``row``."""
    aim = trusted() if target is None else target
    if group is None and "lang" in docs.columns:
        group = F.col("lang")
    rows = materialize(spark, measured(docs, keep, group).withColumn("in_target", aim), "measured")
    table = _table(log_ratios(rows, F.col("in_target")), ".6f")
    total = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int")))
    score = F.when(F.size("buckets") == 0, F.lit(0.0)).otherwise(total / F.size("buckets"))
    scored = rows.withColumn("score", F.round(score, 9))
    cut = F.get(_table(medians(scored, F.col("in_target")), ".4f"), F.col("group")) - F.lit(margin)
    return scored.withColumn("cut", F.round(cut, 9)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("cut"))).select("row", *BASE, "base_failed", "in_target", "score", "cut", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, documents(spark, sf_dir)).select("row.doc_id", *BASE, "base_failed", "kept", "score", "cut")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(spark, docs, docs.columns).where("kept").select("row.*")
