"""URL filter: a blocked Bloom filter of listed canonical keys, then an exact hash join.

A listed rule is a host and a path prefix; its canonical key is ``host`` and ``path`` with a line feed between. A URL's
candidate keys are its host and all parent domains, each with the URL's path cut to every length a listed path has.
Each distinct URL's candidates are asked in the filter, whose bits of one key all lie in one block of 512; what passes
is joined with the list by hash, which removes the false positives. The longest rule that fits gives the verdict;
without one the URL isn't listed and is allowed.

The filter is a table at every size of the list: a row of eight words for each block, built by sums of bits. Asking is a
join on the block's number, so a small filter is sent to the executors and a large one is dealt out, as adaptive
execution sees fit; keys are hashed, and a key asked by many URLs is a skewed join that it splits. Nothing of the filter
comes to the driver, only the distinct lengths of listed paths, at most as many as the longest path has characters.

Defined results: a null URL, or one without ``://``, has empty host and path and is allowed, and null URLs take no part
in the joins; a URL of any length or number of labels is asked whole; a repeated rule counts once; of equally long
rules block wins over allow; repeated rows are kept; extra columns are ignored, whatever their names; no rows give no
rows; without rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the registered query: verdict, host, path (fixed values).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
BITS_PER_KEY = 12
PROBES = 6
WORDS = 8  # of 64 bits in a block


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _split(h: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a hash, and its bits there."""
    block = F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).cast("bigint")
    mask = F.lit(0xFFFF).cast("bigint")
    low, step = h.bitwiseAND(mask), F.shiftrightunsigned(h, 16).bitwiseAND(mask).bitwiseOR(F.lit(1).cast("bigint"))
    return block, [((low + i * step + i * i) % (64 * WORDS)).cast("int") for i in range(PROBES)]


def build_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """The filter of hashed keys (column h) as rows (block, word0 ... word7), and its number of blocks."""
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // (64 * WORDS)))
    block, bits = _split(F.col("h"), blocks)
    placed = keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    one = F.expr("shiftleft(1L, bit % 64)")
    words = [F.bit_or(F.when(F.expr("bit div 64") == w, one).otherwise(F.lit(0).cast("bigint"))).alias(f"word{w}") for w in range(WORDS)]
    return placed.groupBy("block").agg(*words), blocks


def passing(asked: DataFrame, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``asked`` (a column h) whose bits are all set in their block."""
    block, bits = _split(F.col("h"), blocks)
    found = asked.withColumns({"block": block, "bits": F.array(*bits)}).join(filter_rows, "block")
    words = F.array(*[f"word{w}" for w in range(WORDS)])
    is_set = F.forall("bits", lambda b: F.getbit(F.get(words, F.floor(b / 64).cast("int")), b % 64) == 1)
    return found.where(is_set).select(*asked.columns)


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``rules`` has verdict, host and path."""
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", canonical(F.col("host"), F.col("path")))
    found = listed.select(F.length("path").alias("n")).where("n is not null").distinct().collect()  # one row a length
    lengths = F.split(F.lit(",".join(str(r["n"]) for r in sorted(found))), ",").cast("array<int>") if found else F.array().cast("array<int>")  # one constant
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = own.where("url is not null").select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    asked = urls.select("url", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: canonical(h, p))))).alias("key")).withColumn("h", F.xxhash64("key"))
    hit = passing(asked, *build_filter(listed.select(F.xxhash64("key").alias("h")))).join(listed, "key")
    longest = F.struct((F.length("host") + F.length("path")).alias("n"), "verdict", F.concat("host", "path").alias("rule"))
    best = hit.groupBy("url").agg(F.max(longest).alias("r")).select("url", "r.rule", "r.verdict")
    none = own.where("url is null").select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    rows = own.where("url is not null").join(best, "url", "left").unionByName(none)
    return rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
