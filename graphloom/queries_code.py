"""Registered queries of source extraction, index runs, change sets, catalogs and control tables, with their SQL.

The source tree is a fixed one, so its SQL is the rows that it must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import sync
from graphloom.functions import scalar
from graphloom.operators import change, context, federated, resolve, walk
from graphloom.plans import graph_view as g
from graphloom.plans import index_job
from graphloom.queries import SHARDS, _shards, graph_sql, query, read, rounded, seeds_of, stored
from graphloom.sources import extract, files
from graphloom.streaming import watch
from graphloom.tables import dealt, delete_files, fresh_path, ignore_duplicate_symbols, parts_of, rename_files, replace_files

SOURCES = {
    "app/service.py": "import os\nfrom app.util import helper as h\nfrom . import other\n\nMAX_RETRIES = 3\n\n\nclass Service:\n    def __init__(self, store: Store):\n        self.store = store\n\n    def run(self, n: int) -> str:\n        self.stop()\n        self.store.save(n)\n        return h(n)\n\n    def stop(self):\n        pass\n\n\nasync def handler(x: str) -> str:\n    s = Service(None)\n    s.run(1)\n    return x\n",
    "app/util.py": "def helper(n):\n    return n\n",
    "app/other.py": "class Store:\n    def save(self, n):\n        return helper(n)\n",
    "app/broken.py": "def (:\n",
    "src/Auth.java": "package com.acme;\nimport com.acme.Base;\npublic class Auth {\n    public static boolean login(String user, int n) {\n        Store s = new Store();\n        return check(user);\n    }\n}\n",
    "com/acme/Base.java": "package com.acme;\npublic interface Base {\n}\n",
    "web/auth.ts": "import { token as t } from './token';\nexport interface Port {}\nexport class Auth {\n  async login(user: string): Promise<string> { return t(user); }\n}\nexport const make = (n: number): string => `${n}`;\nexport const URL = 'x';\n",
    "web/token.ts": "export function token(u: string) { return u; }\n",
    "go/main.go": 'package main\nimport (\n\t"fmt"\n)\nconst Max = 3\ntype Service struct {}\nfunc Login(user string) bool { return verify(user) }\nfunc (s *Service) verify(user string) bool { return true }\n',
}


def values(names: str, rows: list[tuple]) -> str:
    """SQL for rows that are known."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


def tree(spark: SparkSession) -> DataFrame:
    rows = [(p, t) for p, t in SOURCES.items()]
    listed = spark.createDataFrame(rows, "path string, text string")
    return listed.select("path", scalar.language_of(F.col("path")).alias("language"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("size_bytes"), "text")


def facts(spark: SparkSession) -> DataFrame:
    return extract.extract(tree(spark))


SYMBOLS = [
    ("MAX_RETRIES", "app.service.MAX_RETRIES", "constant", "app/service.py", 5, 5, None, "public"),
    ("Service", "app.service.Service", "class", "app/service.py", 8, 18, None, "public"),
    ("__init__", "app.service.Service.__init__", "method", "app/service.py", 9, 10, None, "private"),
    ("run", "app.service.Service.run", "method", "app/service.py", 12, 15, "str", "public"),
    ("stop", "app.service.Service.stop", "method", "app/service.py", 17, 18, None, "public"),
    ("handler", "app.service.handler", "function", "app/service.py", 21, 24, "str", "public"),
    ("helper", "app.util.helper", "function", "app/util.py", 1, 2, None, "public"),
    ("Store", "app.other.Store", "class", "app/other.py", 1, 3, None, "public"),
    ("save", "app.other.Store.save", "method", "app/other.py", 2, 3, None, "public"),
    ("Auth", "com.acme.Auth", "class", "src/Auth.java", 3, 8, None, "public"),
    ("login", "com.acme.Auth.login", "method", "src/Auth.java", 4, 4, "boolean", "public"),
    ("Base", "com.acme.Base", "interface", "com/acme/Base.java", 2, 3, None, "public"),
    ("Port", "web.auth.Port", "interface", "web/auth.ts", 2, 2, None, "public"),
    ("Auth", "web.auth.Auth", "class", "web/auth.ts", 3, 3, None, "public"),
    ("login", "web.auth.Auth.login", "method", "web/auth.ts", 4, 4, "Promise<string>", "public"),
    ("make", "web.auth.make", "function", "web/auth.ts", 6, 6, "string", "public"),
    ("URL", "web.auth.URL", "constant", "web/auth.ts", 7, 7, None, "public"),
    ("token", "web.token.token", "function", "web/token.ts", 1, 1, None, "public"),
    ("Max", "main.Max", "constant", "go/main.go", 5, 5, None, "public"),
    ("Service", "main.Service", "class", "go/main.go", 6, 6, None, "public"),
    ("Login", "main.Login", "function", "go/main.go", 7, 7, "bool", "public"),
    ("verify", "main.Service.verify", "method", "go/main.go", 8, 8, "bool", "private"),
]
SYMBOL_NAMES = "name, qualified_name, kind, file_path, start_line, end_line, return_type, visibility"


@query(values(SYMBOL_NAMES, SYMBOLS))
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, E3-E6, N14-N16."""
    return extract.symbols(facts(spark)).select(*SYMBOL_NAMES.split(", "))


PARAMETERS = [("app.service.Service.run", 0, "self", None), ("app.service.Service.run", 1, "n", "int"), ("app.service.handler", 0, "x", "str"), ("app.util.helper", 0, "n", None), ("app.service.Service.__init__", 0, "self", None), ("app.service.Service.__init__", 1, "store", "Store"), ("app.service.Service.stop", 0, "self", None), ("app.other.Store.save", 0, "self", None), ("app.other.Store.save", 1, "n", None), ("com.acme.Auth.login", 0, "user", "String"), ("com.acme.Auth.login", 1, "n", "int"), ("web.auth.Auth.login", 0, "user", "string"), ("web.auth.make", 0, "n", "number"), ("web.token.token", 0, "u", "string"), ("main.Login", 0, "user", "string"), ("main.Service.verify", 0, "user", "string")]


@query(values("qualified_name, position, name, type", PARAMETERS))
def extracted_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as rows of their own."""
    return extract.symbols(facts(spark)).select("qualified_name", F.explode("parameters").alias("p")).select("qualified_name", "p.position", "p.name", "p.type")


IMPORTS = [("app/service.py", 1, "os"), ("app/service.py", 2, "app.util"), ("app/service.py", 3, "."), ("src/Auth.java", 2, "com.acme.Base"), ("web/auth.ts", 1, "./token"), ("go/main.go", 3, "fmt")]


@query(values("file_path, line_number, module_name", IMPORTS))
def extracted_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2-E5."""
    return extract.imports(facts(spark)).select("file_path", "line_number", "module_name")


CALLS = [("app/service.py", 13, "stop", "self"), ("app/service.py", 14, "save", "store"), ("app/service.py", 15, "h", None), ("app/service.py", 22, "Service", None), ("app/service.py", 23, "run", "s"), ("app/other.py", 3, "helper", None), ("src/Auth.java", 4, "login", None), ("src/Auth.java", 6, "check", None), ("web/auth.ts", 4, "login", None), ("web/auth.ts", 4, "t", None), ("go/main.go", 2, "import", None), ("go/main.go", 7, "verify", None), ("go/main.go", 8, "func", None), ("go/main.go", 8, "verify", None)]


@query(values("file_path, line, callee, receiver", CALLS))
def extracted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7, E8."""
    return extract.calls(facts(spark)).select("file_path", "line", "callee", "receiver")


ALIASES = [("alias", "app/service.py", "os", "os"), ("alias", "app/service.py", "h", "helper"), ("alias", "app/service.py", "other", "other"), ("alias", "web/auth.ts", "t", "token"), ("assigned", "app/service.py", "s", "Service"), ("assigned", "src/Auth.java", "s", "Store")]


@query(values("fact, file_path, name, value", ALIASES))
def extracted_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import aliases, and what is assigned."""
    rows = facts(spark)
    assigned = extract.assignments(rows).select(F.lit("assigned").alias("fact"), "file_path", F.col("receiver").alias("name"), F.col("type_name").alias("value"))
    return extract.aliases(rows).select(F.lit("alias").alias("fact"), "file_path", F.col("alias").alias("name"), F.col("original").alias("value")).unionByName(assigned).distinct()


RECEIVERS = [("app/service.py", 9, 10, "store", "Store"), ("app/service.py", 12, 15, "n", "int"), ("app/service.py", 12, 15, "store", "Store"), ("app/service.py", 17, 18, "store", "Store"), ("app/service.py", 21, 24, "s", "Service"), ("app/service.py", 21, 24, "x", "str")]


@query(values("file_path, start_line, end_line, receiver, type_name", RECEIVERS))
def extracted_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of arguments, assigned names and members."""
    return extract.receiver_types(facts(spark)).where("receiver <> 'self'")


HINTS = [("app/service.py", "os"), ("app/service.py", "app.util"), ("app/service.py", "util"), ("src/Auth.java", "com.acme.Base"), ("src/Auth.java", "Base"), ("web/auth.ts", "./token"), ("web/auth.ts", "token"), ("go/main.go", "fmt")]


@query(values("file_path, hint", HINTS))
def extracted_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9."""
    return extract.import_hints(facts(spark)).where("hint <> '.'")


@query(values("file_path, stage, error", [("app/broken.py", "parse", "SyntaxError")]))
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14."""
    return extract.errors(facts(spark)).select("file_path", "stage", "error")


def _index(spark: SparkSession, listing: DataFrame, rows: DataFrame) -> index_job.Index:
    return index_job.build(spark, listing.drop("text"), rows, ranked=False)


def _edges(index: index_job.Index) -> DataFrame:
    symbol = lambda n: index.symbols.select(F.col("id").alias(f"{n}_id"), F.col("qualified_name").alias(f"{n}_symbol"))
    paths = index.files.select(F.xxhash64("path").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF).cast("bigint")).alias("k"), "path")
    file = lambda n: paths.select(F.col("k").alias(f"{n}_id"), F.col("path").alias(f"{n}_file"))
    rows = index.edges
    for n in ("source", "target"):
        rows = rows.join(symbol(n), f"{n}_id", "left").join(file(n), f"{n}_id", "left")
    return rows.select(F.coalesce("source_symbol", "source_file").alias("source"), F.coalesce("target_symbol", "target_file").alias("target"), "relationship", "line_number", "confidence")


EDGES = [
    ("app.service.Service.run", "app.service.Service.stop", "CALLS", 13, 1.0),
    ("app.service.Service.run", "app.other.Store.save", "CALLS", 14, 1.0),
    ("app.service.Service.run", "app.util.helper", "CALLS", 15, 1.0),
    ("app.service.handler", "app.service.Service", "CALLS", 22, 1.0),
    ("app.service.handler", "app.service.Service.run", "CALLS", 23, 1.0),
    ("app.other.Store.save", "app.util.helper", "CALLS", 3, 1.0),
    ("com.acme.Auth.login", "com.acme.Auth.login", "CALLS", 4, 1.0),
    ("web.auth.Auth.login", "web.auth.Auth.login", "CALLS", 4, 1.0),
    ("web.auth.Auth.login", "web.token.token", "CALLS", 4, 1.0),
    ("main.Login", "main.Service.verify", "CALLS", 7, 1.0),
    ("main.Service.verify", "main.Service.verify", "CALLS", 8, 1.0),
    ("app/service.py", "app/util.py", "IMPORTS", 2, 1.0),
    ("src/Auth.java", "com/acme/Base.java", "IMPORTS", 2, 1.0),
    ("web/auth.ts", "web/token.ts", "IMPORTS", 1, 1.0),
]
EDGE_NAMES = "source, target, relationship, line_number, confidence"


@query(values(EDGE_NAMES, EDGES))
def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run's edges."""
    listing = tree(spark)
    return _edges(_index(spark, listing, extract.extract(listing)))


@query(values("file_path, module_name, line_number", [("app/service.py", "os", 1), ("app/service.py", ".", 3), ("go/main.go", "fmt", 3)]))
def external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, K4."""
    listing = tree(spark)
    rows = extract.imports(extract.extract(listing))
    return resolve.resolve_imports(rows, listing)[1].select("file_path", "module_name", "line_number")


@query(values(EDGE_NAMES, [("main.Service.verify", "main.helper", "CALLS", 4, 1.0), ("main.helper", "main.helper", "CALLS", 3, 1.0)]).replace("SELECT *", "SELECT source, target, relationship, line_number, CAST(confidence AS DOUBLE) AS confidence"))
def incremental_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of the tree is changed, all others go."""
    listing = tree(spark)
    rows = extract.extract(listing)
    text = "package main\ntype Service struct {}\nfunc helper() bool { return helper() }\nfunc (s *Service) verify(user string) bool { return helper() }\n"
    fresh = spark.createDataFrame([("go/main.go", "go", text)], "path string, language string, text string")
    changed = replace_files(rows, extract.extract(fresh), listing.select("path"))
    found = _edges(_index(spark, fresh, changed))
    return found.where("source <> target OR line_number = 3")


# -- files and rules -----------------------------------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("src/a", "build/b", "node_modules/c", "lib/test", ".env", "conf/id_rsa")]), (key % 6 + 1).cast("int"))
    ends = F.element_at(F.array(*[F.lit(x) for x in (".py", ".log", "")]), (key % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(key.alias("k"), F.concat(kinds, ends).alias("path"))


@query("""WITH p AS (SELECT p_partkey AS k, ['src/a', 'build/b', 'node_modules/c', 'lib/test', '.env', 'conf/id_rsa'][CAST(p_partkey % 6 + 1 AS INT)] || ['.py', '.log', ''][CAST(p_partkey % 3 + 1 AS INT)] AS path FROM part)
SELECT k, path FROM p WHERE path NOT LIKE 'build/%' AND path NOT LIKE '%.log' AND path NOT LIKE 'node_modules/%' AND path NOT IN ('.env', 'conf/id_rsa') AND path NOT LIKE '.env.%'""")
def wanted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8-F11, F16, S2."""
    rules = files.rules(["# built", "", "./build/", "*.log"])
    return _paths(spark, sf_dir).where(files.wanted(F.col("path"), exclude=rules))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'R' END AS status, CASE o_orderkey % 4 WHEN 3 THEN 'new' ELSE 'f' END || o_orderkey AS path, CASE o_orderkey % 4 WHEN 3 THEN 'f' || o_orderkey END AS old_path FROM orders")
def git_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even keys as lines of a status, odd ones as lines of a diff."""
    key = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" M f"), key)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("A\tf"), key)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("D  f"), key)).otherwise(F.concat(F.lit("R100\tf"), key, F.lit("\tnew"), key))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", line.alias("value"))
    found = files.git_status(rows.where("o_orderkey % 2 = 0")).unionByName(files.git_diff(rows.where("o_orderkey % 2 = 1")))
    return found.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint").alias("k"), "status", "path", "old_path")


@query("SELECT DISTINCT 'f' || l_partkey AS file_path, CAST(l_linenumber + unnest(range(0, CAST(trunc(l_quantity) AS BIGINT) + 1)) AS INT) AS line, 'r' AS receiver, 'T' || l_suppkey AS owner_type FROM lineitem")
def semantic_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hint for each line of its range."""
    raw = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path"), F.col("l_linenumber").cast("int").alias("line_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).cast("int").alias("line_end"), F.lit("r").alias("receiver"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("owner_type"))
    return files.semantic_hints(raw)


# -- tables ----------------------------------------------------------------------------------------------------------


@query(graph_sql("SELECT id, qualified_name, file_path FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name, file_path ORDER BY start_line, id) AS n FROM (SELECT id, name AS qualified_name, file_path, start_line FROM g_symbols WHERE kind = 'function' AND file_path <> 'src/brand1.py' UNION ALL SELECT id + 7000000000, name, file_path, start_line + 1 FROM g_symbols WHERE kind = 'function') u) t WHERE n = 1"))
def replaced_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: a file's symbols are replaced, and of one name in a file the first stays."""
    old = g.symbols(spark, sf_dir).where("kind = 'function'").select("id", F.col("name").alias("qualified_name"), "file_path", "start_line")
    new = old.select((F.col("id") + 7_000_000_000).alias("id"), "qualified_name", "file_path", (F.col("start_line") + 1).alias("start_line"))
    rows = replace_files(old, new, spark.createDataFrame([("src/brand1.py",)], "path string"))
    return ignore_duplicate_symbols(rows).select("id", "qualified_name", "file_path")


@query(graph_sql("SELECT 'symbol' AS kind, id, 0 AS target FROM g_symbols WHERE file_path NOT IN ('src/main.py', 'src/brand1.py') UNION ALL SELECT 'edge', e.source_id, e.target_id FROM g_edges e JOIN g_symbols s ON s.id = e.source_id WHERE s.file_path NOT IN ('src/main.py', 'src/brand1.py')"))
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: symbols and outgoing edges go, incoming ones dangle."""
    gr = g.graph(spark, sf_dir)
    gone = spark.createDataFrame([("src/main.py",), ("src/brand1.py",)], "path string")
    listing = gr.symbols.select(F.col("file_path").alias("path")).distinct()
    parts = parts_of(gr.edges)
    edges = dealt(gr.edges, parts, "source_id").join(dealt(gr.symbols.select(F.col("id").alias("source_id"), "file_path"), parts, "source_id"), "source_id")
    _, symbols, rest = delete_files(listing, gr.symbols, edges, gone)
    return symbols.select(F.lit("symbol").alias("kind"), "id", F.lit(0).cast("bigint").alias("target")).unionByName(rest.select(F.lit("edge").alias("kind"), F.col("source_id").alias("id"), F.col("target_id").alias("target")))


@query(graph_sql("SELECT id, CASE WHEN file_path = 'src/main.py' THEN 'src/moved.py' ELSE file_path END AS file_path, qualified_name FROM g_symbols"))
def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6."""
    moved = spark.createDataFrame([("src/main.py", "src/moved.py")], "old_path string, path string")
    return rename_files(g.symbols(spark, sf_dir), moved).select("id", "file_path", "qualified_name")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("queued", "retry", "pushed", "failed")]), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("repo_id"), status.alias("status"), F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("last_error"), F.col("ts").alias("created_at"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND event_id % 4 IN (0, 1) ORDER BY ts, event_id LIMIT 25")
def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 25 that wait."""
    return change.pending(_queue(spark, sf_dir), "click", 25).select("id")


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'pushed' ELSE 'retry' END ELSE CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'retry' WHEN 2 THEN 'pushed' ELSE 'failed' END END AS status, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS attempt_count FROM events")
def queue_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: new states; an unknown one is a retry."""
    marks = read(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "pushed").otherwise("odd").alias("status"), F.lit("e").alias("last_error"))
    return change.marked(_queue(spark, sf_dir), marks).select("id", "status", "attempt_count")


@query("SELECT event_type AS repo_id, CASE WHEN event_type IN ('click', 'error') THEN 'open' ELSE 'closed' END AS state, CAST(CASE WHEN event_type IN ('click', 'error') THEN 3 ELSE 0 END AS INT) AS failures FROM events GROUP BY 1")
def control_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a control table take the place of those of their key."""
    table = read(spark, sf_dir, "events").select(F.col("event_type").alias("repo_id")).distinct().select("repo_id", F.lit("closed").alias("state"), F.lit(0).alias("failures"))
    return sync.record(table, table.where("repo_id IN ('click', 'error')").select("repo_id", F.lit("open").alias("state"), F.lit(3).alias("failures")), ["repo_id"])


@query("SELECT event_id AS id, event_type AS run_id FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id + 1000000000, event_type FROM events WHERE event_type = 'error'")
def control_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's diagnostics are cleared, and new ones appended."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("run_id"))
    again = rows.where("run_id = 'error'").select((F.col("id") + 1_000_000_000).alias("id"), "run_id")
    return sync.record(sync.clear_run(rows, "error"), again)


# -- deltas ----------------------------------------------------------------------------------------------------------


def _delta(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    gr = g.graph(spark, sf_dir)
    changes = spark.createDataFrame([("M", "src/nation_3/app.py", None), ("R", "src/main2.py", "src/main.py")], "status string, path string, old_path string")
    listing = gr.symbols.select(F.col("file_path").alias("path")).distinct().select("path", F.lit("h").alias("content_hash"), F.lit(1).cast("bigint").alias("size_bytes"))
    return change.build_delta(changes, listing, gr.symbols, gr.edges.withColumn("file_path", F.lit("")))


DELTA = "d AS (SELECT a.qualified_name AS source, a.file_path AS source_file, b.qualified_name AS target, e.relationship, e.confidence FROM g_edges e JOIN g_symbols a ON a.id = e.source_id JOIN g_symbols b ON b.id = e.target_id WHERE a.file_path IN ('src/nation_3/app.py', 'src/main.py'))"


@query(graph_sql("SELECT source, source_file, target, relationship, CAST(confidence AS DOUBLE) AS confidence FROM d", DELTA))
def delta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y1, J5."""
    return _delta(spark, sf_dir)["edges"].select(F.col("source.qualified_name").alias("source"), F.col("source.file_path").alias("source_file"), F.col("target.qualified_name").alias("target"), "relationship", "confidence")


@query("SELECT * FROM (VALUES ('M', 'src/nation_3/app.py', 'h'), ('R', 'src/main2.py', NULL)) t(status, path, content_hash)")
def delta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19."""
    return _delta(spark, sf_dir)["files"].select("status", "path", "content_hash")


@query(graph_sql("SELECT DISTINCT source, target, relationship FROM d WHERE confidence >= 0.85", DELTA))
def promoted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2, F15, U8."""
    artifact, _ = change.promote(_delta(spark, sf_dir), min_confidence=0.85, max_ambiguity=1.0)
    return artifact["edges"].select(F.col("source.qualified_name").alias("source"), F.col("target.qualified_name").alias("target"), "relationship")


def _named_edges(spark: SparkSession, sf_dir: str, condition: str, origin: str) -> DataFrame:
    end = lambda k, b: F.struct(F.concat(F.lit("p"), k.cast("string")).alias("qualified_name"), b.alias("file_path"))
    part = read(spark, sf_dir, "part")
    return part.where(condition).select(end(F.col("p_partkey"), F.col("p_brand")).alias("source"), end(F.col("p_partkey") % 100, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 4 + 1).cast("string"))).alias("target"), F.lit("CALLS").alias("relationship"), F.lit(origin).alias("origin"))


@query("""WITH e AS (SELECT p_partkey AS k, p_brand AS b, 'Brand#' || (p_partkey % 4 + 1) AS tb FROM part)
SELECT 'p' || k AS source, 'p' || (k % 100) AS target, CASE WHEN k % 5 = 0 THEN 'local' ELSE 'artifact' END AS origin FROM e
WHERE k % 5 = 0 OR (k % 3 <> 0 AND b NOT IN ('Brand#1', 'Brand#2') AND tb NOT IN ('Brand#1', 'Brand#2'))""")
def reconciled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges; neither end of an artifact's edge may lie in a touched path."""
    none = spark.createDataFrame([], "qualified_name string, file_path string")
    artifact = {"symbols": none, "edges": _named_edges(spark, sf_dir, "p_partkey % 3 <> 0", "artifact")}
    local = {"symbols": none, "edges": _named_edges(spark, sf_dir, "p_partkey % 5 = 0", "local")}
    touched = spark.createDataFrame([("Brand#1",), ("Brand#2",)], "path string")
    return change.reconcile(artifact, local, touched)["edges"].select(F.col("source.qualified_name").alias("source"), F.col("target.qualified_name").alias("target"), "origin")


@query("SELECT 'u' || user_id AS path, 'A' AS status FROM events GROUP BY user_id")
def stream_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the state of a stream, read until its input is used up; every path is new."""
    folder = fresh_path(spark, "feed")
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("hash"), F.col("event_id").alias("seq"))
    rows.write.parquet(folder)
    out = fresh_path(spark, "diff")
    stream = watch.stateful_diff(spark.readStream.schema("path string, hash string, seq bigint").parquet(folder))
    keep = lambda df, n: df.write.mode("append").parquet(out)
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "diff_state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, status string").parquet(out)


# -- catalog, routes, workspaces -------------------------------------------------------------------------------------


def _registry(spark: SparkSession) -> DataFrame:
    return spark.range(25).select(F.concat(F.lit("repo"), F.col("id").cast("string")).alias("repo_id"), (F.col("id") % 7 != 0).alias("enabled"))


ROUTES = SHARDS + """, top AS (SELECT repo_id, pagerank_score, qualified_name FROM fs WHERE name ILIKE '%red widget%' ORDER BY pagerank_score DESC, qualified_name, repo_id, file_path LIMIT 100)
, best AS (SELECT repo_id, min({'a': -pagerank_score, 'b': qualified_name}) AS b FROM top GROUP BY 1)"""


@query(graph_sql("SELECT repo_id, place FROM (SELECT repo_id, row_number() OVER (ORDER BY b, repo_id) AS place FROM best) t WHERE place <= 16", ROUTES))
def route_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that export a name."""
    exported = federated.exported_symbols(_shards(spark, sf_dir)[0])
    return federated.route_symbol(exported, _registry(spark), "red widget")


@query("SELECT repo_id, place FROM (SELECT 'repo' || k AS repo_id, row_number() OVER (ORDER BY 'repo' || k) AS place FROM range(25) r(k) WHERE k % 7 <> 0) t WHERE place <= 16")
def route_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that none exports goes to all enabled repositories, up to the cap."""
    exported = federated.exported_symbols(_shards(spark, sf_dir)[0])
    return federated.route_symbol(exported, _registry(spark), "no such name")


def _catalog(spark: SparkSession, sf_dir: str) -> federated.Catalog:
    shards = _registry(spark).select("repo_id", F.lit("/").alias("repo_path"), "enabled", F.lit(0).cast("bigint").alias("symbol_count"), F.lit(0).cast("bigint").alias("edge_count"))
    symbols, _ = _shards(spark, sf_dir)
    repo = lambda c: F.concat(F.lit("repo"), (F.col(c) % 25).cast("string"))
    edges = read(spark, sf_dir, "lineitem").select(repo("l_partkey").alias("source_repo_id"), F.col("l_partkey").cast("string").alias("source_qualified_name"), F.lit("f").alias("source_file_path"), repo("l_suppkey").alias("target_repo_id"), F.col("l_suppkey").cast("string").alias("target_qualified_name"), F.lit("g").alias("target_file_path"), F.lit("IMPORTS").alias("relationship"), F.col("l_discount").alias("confidence"))
    empty = edges.limit(0)
    return federated.Catalog(shards, symbols, empty).with_edges(edges)


@query("""WITH e AS (SELECT 'repo' || (l_partkey % 25) AS s, 'repo' || (l_suppkey % 25) AS t, l_partkey, l_suppkey, max(l_discount) AS c FROM lineitem GROUP BY ALL)
SELECT CAST(l_partkey AS VARCHAR) AS source_qualified_name, CAST(l_suppkey AS VARCHAR) AS target_qualified_name, c AS confidence FROM e WHERE s <> 'repo3' AND t <> 'repo3'""")
def catalog_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are kept once by their keys, and go with a shard at either end."""
    return _catalog(spark, sf_dir).unregister("repo3").cross.select("source_qualified_name", "target_qualified_name", "confidence")


@query(graph_sql("SELECT r.repo_id, CAST(coalesce(s.n, 0) AS BIGINT) AS symbol_count FROM (SELECT 'repo' || k AS repo_id FROM range(25) r(k) WHERE k <> 3 AND (k % 7 <> 0 OR k = 14)) r LEFT JOIN (SELECT repo_id, count(*) AS n FROM fs GROUP BY 1) s ON s.repo_id = r.repo_id", SHARDS))
def catalog_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled shards with their counts after one is registered again and one unregistered."""
    symbols, edges = _shards(spark, sf_dir)
    again = spark.createDataFrame([("repo14", "/new")], "repo_id string, repo_path string")
    found = _catalog(spark, sf_dir).register(again).counted(federated.shard_report(symbols, edges)).unregister("repo3")
    return found.listed().select("repo_id", "symbol_count")


@query(graph_sql("SELECT root, id, name FROM (SELECT repo_id AS root, id, name, pagerank_score, qualified_name, file_path FROM fs WHERE (lower(name) LIKE '%red%' OR lower(qualified_name) LIKE '%red%') AND (id % 25) % 7 <> 0 ORDER BY pagerank_score DESC, qualified_name, root, file_path LIMIT 30 OFFSET 20) t", SHARDS))
def workspace_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page over all enabled roots."""
    symbols = _shards(spark, sf_dir)[0].withColumnRenamed("repo_id", "root")
    return federated.workspace_search(symbols, _registry(spark).withColumnRenamed("repo_id", "root"), "red", limit=30, offset=20).select("root", "id", "name")


@query(graph_sql("SELECT kind, count(*) AS n FROM g_symbols WHERE pagerank_score > 0.05 GROUP BY kind"))
def sql_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8."""
    from graphloom.api import Engine

    gr = g.graph(spark, sf_dir)
    return Engine(spark, gr.symbols, gr.edges).sql("SELECT kind, count(*) AS n FROM {symbols} WHERE pagerank_score > :least GROUP BY kind", {"least": 0.05})


# -- scores and names --------------------------------------------------------------------------------------------------


@query(graph_sql("SELECT id, CASE WHEN regexp_matches(name, '^_') THEN 'private' ELSE 'public' END AS visible, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'private' END AS go_visible FROM g_symbols"))
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N14."""
    way = lambda language: scalar.visibility(F.col("name"), F.lit(language))
    return g.symbols(spark, sf_dir).select("id", way("python").alias("visible"), way("go").alias("go_visible"))


@query(graph_sql("SELECT id, list_sort(list_distinct([lower(qualified_name), string_split(lower(qualified_name), '.')[-1]])) AS tokens FROM g_symbols").replace("list_sort(", "array_to_string(list_sort(").replace("[-1]]))", "[-1]])), ' ')"))
def type_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N17."""
    return g.symbols(spark, sf_dir).select("id", F.array_join(F.sort_array(scalar.type_tokens(F.col("qualified_name"))), " ").alias("tokens"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'a/c' || p_partkey WHEN 1 THEN '/x/' || p_partkey ELSE '../' || p_partkey END AS path FROM part")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N20."""
    key = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("./a//b/../c"), key)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/x/./y/.././"), key)).otherwise(F.concat(F.lit("a/../../"), key))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), scalar.normal_path(raw).alias("path"))


SCORED_BUNDLE = [("seed_hit_rate", 1.0), ("connectedness", 1.0), ("dedupe_ratio", 1.0)]


@query(values("metric, value", SCORED_BUNDLE).replace("SELECT *", "SELECT metric, CAST(value AS DOUBLE) AS value"))
def context_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a bundle that a seed's neighbours all fit in."""
    gr = stored(spark, sf_dir)
    seeds = seeds_of(spark, g.REGION + 1)
    rows = context.get_context(spark, gr.symbols, gr.edges, seeds, "region", budget=600, depth=1)
    found = context.quality(rows, seeds, 600)
    return found.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in SCORED_BUNDLE]), F.array(*[F.col(n) for n, _ in SCORED_BUNDLE]))).alias("metric", "value"))


@query(graph_sql("SELECT s.file_path, s.id FROM (SELECT CAST(5000000001 AS BIGINT) AS id UNION SELECT source_id FROM g_edges WHERE target_id = 5000000001) n JOIN g_symbols s ON s.id = n.id"))
def context_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region and the nations that implement it, by file."""
    gr = stored(spark, sf_dir)
    rows = context.get_context(spark, gr.symbols, gr.edges, seeds_of(spark, g.REGION + 1), "region", budget=600, depth=1)
    return context.by_file(rows).select("file_path", F.explode("symbols").alias("s")).select("file_path", "s.id")


@query(graph_sql("SELECT r.id AS id, s.name, s.file_path, r.depth FROM reached r JOIN g_symbols s ON s.id = r.id WHERE r.depth > 0", "w(id, depth) AS (SELECT CAST(4000000003 AS BIGINT), 0 UNION SELECT e.source_id, w.depth + 1 FROM w JOIN g_edges e ON e.target_id = w.id WHERE e.relationship IN ('EXTENDS', 'IMPLEMENTS') AND w.depth < 1), reached AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"))
def implementors_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extends or implements one symbol."""
    gr = stored(spark, sf_dir, ("EXTENDS", "IMPLEMENTS"))
    near = gr.edges.where(F.col("relationship").isin("EXTENDS", "IMPLEMENTS"))
    found = walk.levels(spark, near.select(F.col("target_id").alias("at"), F.col("source_id").alias("next")), seeds_of(spark, g.NATION + 3), 1)
    return found.where("depth > 0").join(gr.symbols, "id").select("id", "name", "file_path", "depth")
