"""Source trees and change lists as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalar

#: Files that hold secrets and stay out unless asked for (fixed values).
SENSITIVE = [".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_ed25519", "*.crt", "secrets.*"]
#: Folders that never are sources (fixed values).
SKIPPED = [".git", "node_modules", "__pycache__"]


def rules(lines: list[str]) -> list[str]:
    """Ignore rules of a file's lines: no blank lines or comments, no leading './'."""
    return [r.removeprefix("./") for x in lines if (r := x.strip()) and not r.startswith("#")]


def load_rules(spark: SparkSession, *paths: str) -> list[str]:
    """S2 from files; rules are short lists, and a file that isn't there has none."""
    found: list[str] = []
    for p in paths:
        try:
            found += [r["value"] for r in spark.read.text(p).collect()]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return rules(found)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ignored(path: Column, rule: str) -> Column:
    """a glob hits the path or its name, or the path lies below; a rule with a closing '/' only does the latter."""
    folder = rule.rstrip("/")
    below = F.startswith(path, F.lit(folder + "/")) | F.contains(path, F.lit(f"/{folder}/"))
    return below if rule.endswith("/") else scalar.glob_match(path, rule) | F.startswith(path, F.lit(rule + "/"))


def wanted(path: Column, include: list[str] | None = None, exclude: list[str] | None = None, sensitive: bool = False) -> Column:
    """Included (all without patterns), not excluded, not ignored, and not sensitive unless asked for."""
    condition = _any([scalar.glob_match(path, p) for p in include]) if include else F.lit(True)
    out = [ignored(path, r) for r in exclude or []] + [F.contains(F.concat(F.lit("/"), path), F.lit(f"/{s}/")) for s in SKIPPED]
    if not sensitive:
        out += [scalar.glob_match(path, p) for p in SENSITIVE]
    return condition & ~_any(out)


def _escaped(path: str) -> str:
    """A path in which no character is a pattern."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _rows(raw: DataFrame, root: str, include: list[str] | None, exclude: list[str] | None, sensitive: bool) -> DataFrame:
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    quoted = "".join("\\" + c if not c.isalnum() else c for c in base)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), f"^{quoted}/", "")
    rows = raw.select(relative.alias("path"), "content", "length").where(wanted(F.col("path"), include, exclude, sensitive))
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    return rows.select("path", scalar.language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), text)


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, sensitive: bool = False) -> DataFrame:
    """(path, language, content_hash, size_bytes, text) of a tree; paths are relative to ``root``.

    Invalid UTF-8 becomes replacement characters. Listing and reading are Spark's, so any of its file systems do.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _rows(raw, root, include, exclude, sensitive)


def scan_paths(spark: SparkSession, root: str, paths: list[str], include: list[str] | None = None, exclude: list[str] | None = None, sensitive: bool = False) -> DataFrame:
    """``scan`` of the named files only: no other file is listed or opened."""
    base = root.rstrip("/")
    if not paths:
        return _rows(spark.createDataFrame([], "path string, content binary, length bigint"), root, include, exclude, sensitive)
    raw = spark.read.format("binaryFile").load([_escaped(f"{base}/{p}") for p in sorted(set(paths))])
    return _rows(raw, root, include, exclude, sensitive)


def scan_counts(files: DataFrame) -> DataFrame:
    """Files seen, and those in a known language."""
    return files.agg(F.count("*").alias("files_seen"), F.count_if(F.col("language").isNotNull()).alias("files_indexed"))


def git_status(lines: DataFrame) -> DataFrame:
    """Changes from ``value`` lines of porcelain status; the work tree's letter counts before the index's.

    An untracked file is added, ``old -> new`` is a rename.
    """
    v = F.col("value")
    index, tree = F.substring(v, 1, 1), F.substring(v, 2, 1)
    code = F.when(F.startswith(v, F.lit("??")), "A").when(tree != " ", tree).otherwise(index)
    path = F.trim(F.substring(v, 4, 1 << 20))
    moved = F.contains(path, F.lit(" -> ")) & ((index == "R") | (tree == "R"))
    rows = lines.where(F.length(v) > 3).select(code.alias("code"), moved.alias("moved"), path.alias("p"))
    ends = F.split("p", " -> ")
    return rows.select(
        F.when(F.col("moved"), "R").when(F.col("code").isin("A", "D"), F.col("code")).otherwise("M").alias("status"),
        F.when(F.col("moved"), F.element_at(ends, -1)).otherwise(F.col("p")).alias("path"),
        F.when(F.col("moved"), F.element_at(ends, 1)).alias("old_path"),
    )


def git_diff(lines: DataFrame) -> DataFrame:
    """Changes from tab-separated name-status lines."""
    parts = F.split("value", "\t")
    code = F.substring(F.get(parts, 0), 1, 1)
    rows = lines.where(F.size(parts) >= 2).select(code.alias("code"), parts.alias("p"))
    moved = (F.col("code") == "R") & (F.size("p") >= 3)
    return rows.select(F.when(moved, "R").when(F.col("code").isin("A", "D"), F.col("code")).otherwise("M").alias("status"), F.when(moved, F.get("p", 2)).otherwise(F.get("p", 1)).alias("path"), F.when(moved, F.get("p", 1)).alias("old_path"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of a JSON object from paths to hashes."""
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "hash"))


def write_snapshot(listing: DataFrame, path: str) -> None:
    """One JSON object for each part of the listing."""
    listing.groupBy(F.spark_partition_id()).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "hash")))).alias("value")).select("value").write.mode("overwrite").text(path)


def metrics_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def workspace(spark: SparkSession, path: str, fallback: str) -> DataFrame:
    """Enabled roots once each by path; the fallback root if there are none."""
    raw = spark.read.schema("roots array<struct<id:string,path:string,enabled:boolean>>").option("multiLine", "true").json(path)
    roots = raw.select(F.explode("roots").alias("r")).select("r.*").where("path IS NOT NULL").groupBy("path").agg(F.min("id").alias("id"), F.max(F.coalesce("enabled", F.lit(True))).alias("enabled"))
    name = F.element_at(F.split("path", "/"), -1)
    own = roots.where("enabled").select(F.coalesce("id", F.concat(name, F.lit("-"), F.substring(F.sha2("path", 256), 1, 8))).alias("root_id"), "path")
    return own if not own.isEmpty() else spark.createDataFrame([(fallback,)], "path string").select(F.concat(name, F.lit("-"), F.substring(F.sha2("path", 256), 1, 8)).alias("root_id"), "path")


#: Lines of a file that are merged together, so that a long file is several groups.
HINT_BLOCK = 1024


def semantic_hints(raw: DataFrame, most: int = 512) -> DataFrame:
    """(file_path, line, receiver, owner_type) of hints with line_start, line_end; a hint covers at most 513 lines.

    Ranges are dealt out, not lines: in order of their start each gives the lines that those before it don't reach, so
    every line comes once and nothing is compared after ranges are opened.
    """
    last = F.least(F.greatest(F.coalesce("line_end", "line_start"), F.col("line_start")), F.col("line_start") + most)
    ranges = raw.where("line_start IS NOT NULL").select("file_path", "receiver", "owner_type", F.col("line_start").alias("_from"), last.alias("_to"))
    block = lambda c: F.floor(F.col(c) / HINT_BLOCK).cast("int")
    parts = ranges.withColumn("_b", F.explode(F.sequence(block("_from"), block("_to"))))
    parts = parts.withColumns({"_from": F.greatest("_from", F.col("_b") * HINT_BLOCK), "_to": F.least("_to", F.col("_b") * HINT_BLOCK + (HINT_BLOCK - 1))})
    before = W.partitionBy("file_path", "receiver", "owner_type", "_b").orderBy("_from").rowsBetween(W.unboundedPreceding, -1)
    fresh = parts.withColumn("_from", F.greatest("_from", F.max("_to").over(before) + 1)).where("_from <= _to")
    return fresh.select("file_path", F.explode(F.sequence("_from", "_to")).alias("line"), "receiver", "owner_type")


def go_module(spark: SparkSession, path: str) -> str | None:
    """The module named in a go.mod file."""
    found = spark.read.text(path).select(F.regexp_extract("value", "^\\s*module\\s+(\\S+)", 1).alias("m")).where("m <> ''").first()
    return found["m"] if found else None
