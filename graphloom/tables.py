"""Tables on shared storage: materialised steps, versioned snapshots, upserts and partition replacement."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the session has it, and else a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom_shared").rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the driver's JVM has them."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_KNOWN: set[str] = set()
_CLAIMS = threading.Lock()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's place in the shared folder, below one of this application, which goes when the driver ends."""
    base = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"
    if base not in _KNOWN:
        place, system = _hadoop_path(spark, base)
        system.mkdirs(place)
        system.deleteOnExit(place)
        _KNOWN.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts the lineage."""
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the folder of a materialised table that nothing reads any more, as in loops."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graphloom-" in path:
            place, system = _hadoop_path(spark, path)
            system.delete(place, True)


#: Bytes of stored input for each part of a table that is dealt out by size.
PART_BYTES = 8 << 20
_UNKNOWN = 1 << 62


def parts_of(df: DataFrame) -> int:
    """How many parts the stored tables below ``df`` ask for, or 0 where adaptive execution's number does."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    parts = sum(s for s in sizes if s < _UNKNOWN) // PART_BYTES
    return parts if parts > df.sparkSession.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys over ``parts``, so that the rows of one task don't grow with the input.

    Adaptive execution would join parts until there are as many as cores; joins need the same number on both sides.
    """
    return df.repartition(parts, *keys) if parts else df


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to each row in order within its keys, and ``<name>_all``, that of all.

    Rows are dealt out by ranges of keys and order; each part sums its own, and the sums of the parts, a row for each
    part and key, say what lies before. So no key is one task's rows. The dealt table is written, as parts must not move.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())
    own = W.partitionBy("_p", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    parts = materialize(spark, parts.withColumn(name, F.sum(value).over(own)), "parts")
    totals = parts.groupBy("_p", *keys).agg(F.sum(value).alias("_t"))
    if not keys:
        sums = {r["_p"]: r["_t"] or 0 for r in totals.collect()}  # one row a part
        before, done = [], 0
        for p in range(max(sums, default=-1) + 1):
            before.append(done)
            done += sums.get(p, 0)
        kind = parts.schema[name].dataType
        offsets = F.split(F.lit(",".join(map(str, before)) or "0"), ",").cast(T.ArrayType(kind))
        return parts.withColumns({name: F.col(name) + F.get(offsets, F.col("_p")), f"{name}_all": F.lit(done).cast(kind)}).select(*df.columns, name, f"{name}_all")
    group = W.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_t").over(group.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], earlier.alias("_before"), F.sum("_t").over(group).alias(f"{name}_all"))
    on = parts["_p"] == offsets["_q"]
    for i, k in enumerate(keys):
        on = on & parts[k].eqNullSafe(offsets[f"_k{i}"])
    joined = parts.join(offsets, on).withColumn(name, F.col(name) + F.col("_before"))
    return joined.select(*df.columns, name, f"{name}_all")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K1: rows of ``new`` take the place of those with equal keys; null keys are equal."""
    condition = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new, condition, "left_anti").unionByName(new)


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame, column: str = "file_path") -> DataFrame:
    """K2-K4: all rows of the touched ``files`` (one column path) go, those of ``new`` come."""
    touched = files.select(F.col("path").alias(column)).distinct()
    return old.join(touched, column, "left_anti").unionByName(new)


EDGE_KEY = ["source_id", "target_id", "source_type", "target_type", "relationship"]


def ignore_duplicate_edges(edges: DataFrame) -> DataFrame:
    """K3: the first of equal edges by file and line stays."""
    return first_by(edges, EDGE_KEY, [F.col("file_path").asc_nulls_first(), F.col("line_number").asc_nulls_first(), F.col("confidence").desc_nulls_last()])


def ignore_duplicate_symbols(symbols: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """K2: the first of a file's symbols with one qualified name stays."""
    return first_by(symbols, ["qualified_name", "file_path"], order or [F.col("start_line"), F.col("id")])


def delete_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K5: files go with their symbols and the edges that start in them; edges into them dangle."""
    paths = gone.select("path").distinct()
    by_file = paths.withColumnRenamed("path", "file_path")
    return files.join(paths, "path", "left_anti"), symbols.join(by_file, "file_path", "left_anti").select(symbols.columns), edges.join(by_file, "file_path", "left_anti").select(edges.columns)


def rename_files(df: DataFrame, renames: DataFrame, column: str = "file_path") -> DataFrame:
    """K6: paths follow ``renames`` (old_path, path); qualified names stay."""
    moved = renames.select(F.col("old_path").alias(column), F.col("path").alias("_to"))
    return df.join(moved, column, "left").withColumn(column, F.coalesce("_to", column)).select(df.columns)


class Snapshots:
    """A table as folders and pointers from version numbers to them.

    A folder has a name of its own and is complete before a pointer names it, so readers never see half of one and
    writers never touch each other's rows. A version is claimed by a file that can be made only once, so of two writers
    one has it and the other takes the next.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("version bigint, folder string").option("recursiveFileLookup", "true").json(f"{self.root}/pointer")

    def version(self) -> int:
        try:
            return self._pointers().agg(F.max("version")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def _folder(self, version: int) -> str:
        return self._pointers().where(F.col("version") == version).agg(F.min("folder")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._folder(self.version() if version is None else version)}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        folder = f"data-{uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{folder}")
        version = self.version() + 1
        while not self._claimed(version):
            version += 1
        row = self.spark.createDataFrame([(version, folder)], "version bigint, folder string")
        row.coalesce(1).write.json(f"{self.root}/pointer/{version:08d}-{folder}")
        return version

    def _claimed(self, version: int) -> bool:
        place, system = _hadoop_path(self.spark, f"{self.root}/claims/{version:08d}")
        with _CLAIMS:  # some local file systems look first and make then
            return system.createNewFile(place)

    def restore(self, version: int) -> int:
        """A new version with the rows of an old one."""
        return self.write(self.read(version))

    def backup(self, path: str, version: int | None = None) -> None:
        """K7: a copy of a version's rows elsewhere; ``write(spark.read.parquet(path))`` brings it back."""
        self.read(version).write.mode("overwrite").parquet(path)


def migrate(tables: dict[str, DataFrame], version: int, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Steps in order from ``version`` on; a step that fails leaves its tables as they were and ends the run."""
    history = []
    for step in sorted(k for k in steps if k > version):
        try:
            tables = steps[step](dict(tables))
        except Exception as e:
            history.append({"from_version": version, "to_version": step, "status": "failed", "error_message": str(e)})
            break
        history.append({"from_version": version, "to_version": step, "status": "success", "error_message": None})
        version = step
    return tables, history
