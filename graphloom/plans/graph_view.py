"""The star schema seen as a code graph.

Parts are functions, suppliers classes, customers methods, nations interfaces and regions constants; neighbours within an
order call each other, suppliers have the parts they deliver as methods, customers and suppliers extend their
nation, nations implement their region. Identifiers are an offset of the kind plus the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.tables import dealt, parts_of

PART, SUPPLIER, CUSTOMER, NATION, REGION = (i * 1_000_000_000 for i in range(1, 6))


@dataclass(frozen=True)
class Graph:
    symbols: DataFrame
    edges: DataFrame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(table: str, offset: int, key: str, name: str, of: str, path: F.Column, line: F.Column, signature: F.Column, rank: F.Column) -> DataFrame:
        df = _table(spark, sf_dir, table)
        return df.select(
            (F.lit(offset) + F.col(key)).cast("bigint").alias("id"),
            F.col(name).alias("name"),
            F.concat(F.lit(f"{table}."), F.col(name), F.lit("."), F.col(key).cast("string")).alias("qualified_name"),
            F.lit(of).alias("kind"),
            path.alias("file_path"),
            line.cast("int").alias("start_line"),
            (line + 9).cast("int").alias("end_line"),
            signature.alias("signature"),
            F.concat(F.lit(table), F.lit(" "), F.col(name)).alias("docstring"),
            rank.cast("double").alias("pagerank_score"),
        )

    c = F.col
    nation = lambda key: F.concat(F.lit("nation_"), c(key).cast("string"))
    return (
        kind("part", PART, "p_partkey", "p_name", "function", F.concat(F.lit("src/"), F.lower(F.replace(c("p_brand"), F.lit("#"), F.lit(""))), F.lit(".py")), c("p_size"), F.concat(F.lit("def "), c("p_name"), F.lit("("), c("p_type"), F.lit(")")), F.floor("p_retailprice") / 10000.0)
        .unionByName(kind("supplier", SUPPLIER, "s_suppkey", "s_name", "class", F.concat(F.lit("src/"), nation("s_nationkey"), F.lit("/app.py")), c("s_suppkey") % 100 + 1, F.concat(F.lit("class "), c("s_name")), F.floor("s_acctbal") / 20000.0))
        .unionByName(kind("customer", CUSTOMER, "c_custkey", "c_name", "method", F.concat(F.lit("src/"), nation("c_nationkey"), F.lit("/tests/app_test.py")), c("c_custkey") % 500 + 1, F.concat(F.lit("def "), c("c_name"), F.lit("("), c("c_mktsegment"), F.lit(")")), F.floor("c_acctbal") / 20000.0))
        .unionByName(kind("nation", NATION, "n_nationkey", "n_name", "interface", F.lit("src/main.py"), c("n_nationkey") + 1, F.lit(None).cast("string"), c("n_nationkey") / 100.0))
        .unionByName(kind("region", REGION, "r_regionkey", "r_name", "constant", F.lit("lib/region.py"), c("r_regionkey") + 1, F.lit(None).cast("string"), c("r_regionkey") / 100.0))
    )


def edges(spark: SparkSession, sf_dir: str, relationships: tuple[str, ...] | None = None) -> DataFrame:
    """Typed edges; with ``relationships`` only their tables are read."""
    def edge(df: DataFrame, source: F.Column, target: F.Column, relationship: str, line: F.Column, confidence: float) -> DataFrame:
        return df.select(source.cast("bigint").alias("source_id"), target.cast("bigint").alias("target_id"), F.lit("symbol").alias("source_type"), F.lit("symbol").alias("target_type"), F.lit(relationship).alias("relationship"), line.cast("int").alias("line_number"), F.lit(confidence).alias("confidence"))

    c, parts = F.col, {}
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    n = parts_of(lines)
    calls = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey"), n, "l_orderkey").select("l_partkey", "l_linenumber", F.lead("l_partkey").over(order).alias("next")).where("next <> l_partkey")
    calls = dealt(calls, n, "l_partkey", "next").groupBy("l_partkey", "next").agg(F.min("l_linenumber").alias("line"))
    parts["CALLS"] = edge(calls, PART + c("l_partkey"), PART + c("next"), "CALLS", c("line"), 1.0)
    parts["HAS_METHOD"] = edge(dealt(lines.select("l_suppkey", "l_partkey"), n, "l_suppkey", "l_partkey").distinct(), SUPPLIER + c("l_suppkey"), PART + c("l_partkey"), "HAS_METHOD", F.lit(None), 1.0)
    parts["EXTENDS"] = edge(_table(spark, sf_dir, "customer"), CUSTOMER + c("c_custkey"), NATION + c("c_nationkey"), "EXTENDS", F.lit(1), 0.9).unionByName(edge(_table(spark, sf_dir, "supplier"), SUPPLIER + c("s_suppkey"), NATION + c("s_nationkey"), "EXTENDS", F.lit(1), 0.9))
    parts["IMPLEMENTS"] = edge(_table(spark, sf_dir, "nation"), NATION + c("n_nationkey"), REGION + c("n_regionkey"), "IMPLEMENTS", F.lit(1), 0.8)
    out = None
    for name in relationships or tuple(parts):
        out = parts[name] if out is None else out.unionByName(parts[name])
    return out


def graph(spark: SparkSession, sf_dir: str, relationships: tuple[str, ...] | None = None) -> Graph:
    return Graph(symbols(spark, sf_dir), edges(spark, sf_dir, relationships))


#: The same views for the SQL oracle.
SQL = """
g_symbols AS (
  SELECT CAST(1000000000 + p_partkey AS BIGINT) AS id, p_name AS name, 'part.' || p_name || '.' || p_partkey AS qualified_name, 'function' AS kind,
         'src/' || lower(replace(p_brand, '#', '')) || '.py' AS file_path, p_size AS start_line, p_size + 9 AS end_line,
         'def ' || p_name || '(' || p_type || ')' AS signature, 'part ' || p_name AS docstring, floor(p_retailprice) / 10000.0 AS pagerank_score FROM part
  UNION ALL
  SELECT 2000000000 + s_suppkey, s_name, 'supplier.' || s_name || '.' || s_suppkey, 'class', 'src/nation_' || s_nationkey || '/app.py',
         CAST(s_suppkey % 100 + 1 AS INT), CAST(s_suppkey % 100 + 10 AS INT), 'class ' || s_name, 'supplier ' || s_name, floor(s_acctbal) / 20000.0 FROM supplier
  UNION ALL
  SELECT 3000000000 + c_custkey, c_name, 'customer.' || c_name || '.' || c_custkey, 'method', 'src/nation_' || c_nationkey || '/tests/app_test.py',
         CAST(c_custkey % 500 + 1 AS INT), CAST(c_custkey % 500 + 10 AS INT), 'def ' || c_name || '(' || c_mktsegment || ')', 'customer ' || c_name, floor(c_acctbal) / 20000.0 FROM customer
  UNION ALL
  SELECT 4000000000 + n_nationkey, n_name, 'nation.' || n_name || '.' || n_nationkey, 'interface', 'src/main.py', n_nationkey + 1, n_nationkey + 10, NULL, 'nation ' || n_name, n_nationkey / 100.0 FROM nation
  UNION ALL
  SELECT 5000000000 + r_regionkey, r_name, 'region.' || r_name || '.' || r_regionkey, 'constant', 'lib/region.py', r_regionkey + 1, r_regionkey + 10, NULL, 'region ' || r_name, r_regionkey / 100.0 FROM region
), g_calls AS (
  SELECT 1000000000 + l_partkey AS source_id, 1000000000 + nxt AS target_id, min(l_linenumber) AS line_number
  FROM (SELECT l_partkey, l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) t
  WHERE nxt <> l_partkey GROUP BY l_partkey, nxt
), g_edges AS (
  SELECT source_id, target_id, 'CALLS' AS relationship, line_number, 1.0 AS confidence FROM g_calls
  UNION ALL SELECT DISTINCT 2000000000 + l_suppkey, 1000000000 + l_partkey, 'HAS_METHOD', NULL, 1.0 FROM lineitem
  UNION ALL SELECT 3000000000 + c_custkey, 4000000000 + c_nationkey, 'EXTENDS', 1, 0.9 FROM customer
  UNION ALL SELECT 2000000000 + s_suppkey, 4000000000 + s_nationkey, 'EXTENDS', 1, 0.9 FROM supplier
  UNION ALL SELECT 4000000000 + n_nationkey, 5000000000 + n_regionkey, 'IMPLEMENTS', 1, 0.8 FROM nation
)"""
