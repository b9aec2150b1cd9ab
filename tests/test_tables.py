import threading

from pyspark.sql import functions as F

from graphloom import sync
from graphloom.operators import context, federated, metrics
from graphloom.plans import index_job
from graphloom.tables import Snapshots, discard, fresh_path, materialize, running_sum


def test_running_sums(spark):
    rows = [(k, v, v % 3 + 1) for k in ("a", "b", None) for v in range(200)]
    df = spark.createDataFrame(rows, "k string, v int, w int").repartition(5)
    got = {(r["k"], r["v"]): (r["s"], r["s_all"]) for r in running_sum(df, ["k"], [F.desc("v")], "w", "s").collect()}
    for k in ("a", "b", None):
        done = 0
        for v in range(199, -1, -1):
            done += v % 3 + 1
            assert got[k, v] == (done, sum(x % 3 + 1 for x in range(200)))
    assert sorted(r["n"] for r in running_sum(df, [], [F.col("v"), F.col("k")], "w", "n").select("n").collect())[-1] == sum(r[2] for r in rows)


def test_plans_have_no_single_task(spark):
    symbols = spark.range(50).selectExpr("id", "concat('n', id) AS name", "concat('m.n', id) AS qualified_name", "'function' AS kind", "concat('f', id % 5) AS file_path", "1 AS start_line", "2 AS end_line", "'def n()' AS signature", "1.0 / (1 + id) AS pagerank_score")
    rows = spark.range(100).selectExpr("id % 3 AS k", "rand(1) AS v")
    for df in (context.structure_lines(symbols), metrics.index_percentiles(rows, ["k"], "v", {"p": 0.5})):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    text = context.structure_text(context.structure(symbols, budget=40, ranked=True))
    assert text.count("[TOP]") and text.splitlines()[0] == "f0"


def test_folders_go_and_names_are_new(spark):
    one = materialize(spark, spark.range(3), "x")
    assert one.count() == 3 and fresh_path(spark, "x") != fresh_path(spark, "x")
    discard(spark, one)
    assert spark.sparkContext.applicationId in fresh_path(spark, "y")


def test_two_writers_of_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    assert s.version() == 0 and s.write(spark.range(1)) == 1
    found = []
    threads = [threading.Thread(target=lambda n=n: found.append((n, s.write(spark.range(n))))) for n in (5, 6, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len({v for _, v in found}) == 3
    assert all(s.read(v).count() == n for n, v in found) and s.read(1).count() == 1
    assert s.read(s.restore(1)).count() == 1
    s.backup(str(tmp_path / "copy"), 1)
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 1


def test_incremental_runs_read_changed_files_only(spark, tmp_path):
    for name in ("a.py", "b[1].py", "c.py"):
        (tmp_path / name).write_text(f"def f_{name[0]}():\n    return 1\n")
    old = index_job.full_index(spark, str(tmp_path))
    (tmp_path / "a.py").unlink()  # an unchanged file that cannot be read any more
    (tmp_path / "b[1].py").write_text("def g():\n    return f_c()\n")
    step = index_job.incremental_index(spark, old, str(tmp_path), spark.createDataFrame([("M", "b[1].py", None)], "status string, path string, old_path string"))
    assert {r["name"] for r in step.symbols.collect()} == {"f_a", "g", "f_c"} and step.edges.count() == 1
    none = index_job.incremental_index(spark, step, str(tmp_path), spark.createDataFrame([("D", "c.py", None)], "status string, path string, old_path string"))
    assert {r["name"] for r in none.symbols.collect()} == {"f_a", "g"}


def test_catalog(spark):
    shards = spark.createDataFrame([("a", "/a", True, 1, 1), ("b", "/b", False, 2, 2)], "repo_id string, repo_path string, enabled boolean, symbol_count long, edge_count long")
    exported = spark.createDataFrame([("a", "a.x", "x"), ("b", "b.y", "y")], "repo_id string, qualified_name string, name string")
    edge = lambda s, t, c: (s, f"{s}.x", "f", t, f"{t}.y", "g", "IMPORTS", c)
    shape = ", ".join(f"{k} string" for k in federated.CROSS_KEY) + ", confidence double"
    c = federated.Catalog(shards, exported, spark.createDataFrame([edge("a", "b", 0.5), edge("b", "c", 1.0), edge("c", "d", 1.0)], shape))
    c = c.register(spark.createDataFrame([("b", "/new"), ("c", "/c")], "repo_id string, repo_path string"))
    assert [(r["repo_id"], r["repo_path"]) for r in c.listed().collect()] == [("a", "/a"), ("b", "/new"), ("c", "/c")]
    c = c.with_edges(spark.createDataFrame([edge("a", "b", 0.9), edge("a", "d", 0.3)], shape))
    assert sorted((r["target_repo_id"], r["confidence"]) for r in c.edges_of("a", direction="out").collect()) == [("b", 0.9), ("d", 0.3)]
    assert c.edges_of("b", "b.y", "in").count() == 1 and c.edges_of("b", "b.x").count() == 1
    c = c.counted(spark.createDataFrame([("c", 7, 8)], "repo_id string, symbols long, edges long"))
    assert c.shard("c").first()["symbol_count"] == 7 and c.shard("a").first()["symbol_count"] == 1
    gone = c.unregister("a")
    assert gone.listed(False).count() == 2 and gone.exported.count() == 1 and gone.cross.count() == 2


def test_routes(spark):
    exported = spark.createDataFrame([("a", "a.Load", "Load", "function", "f", 0.1), ("b", "b.reload", "reload", "function", "f", 0.9)], "repo_id string, qualified_name string, name string, kind string, file_path string, pagerank_score double")
    shards = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("off", False)], "repo_id string, enabled boolean")
    shape = ", ".join(f"{k} string" for k in federated.CROSS_KEY)
    cross = spark.createDataFrame([("c", "load", "f", "b", "b.reload", "g", "IMPORTS"), ("b", "load", "f", "d", "d.z", "g", "IMPORTS"), ("x", "load", "f", "y", "y.z", "g", "IMPORTS")], shape)
    names = lambda df: [r["repo_id"] for r in df.collect()]
    assert names(federated.route_symbol(exported, shards, "load").orderBy("place")) == ["b", "a"]
    assert names(federated.route_symbol(exported, shards, "nothing").orderBy("place")) == ["a", "b", "c"]
    assert names(federated.route(exported, cross, shards, "load", "c")) == ["c", "b", "a", "d"]  # b's edge leads to d; x and y are not matched
    assert names(federated.route(exported, cross, shards, "nothing")) == ["a", "b", "c"]


def test_workspace_search(spark):
    symbols = spark.createDataFrame([("r1", 1, "load", "a.load", "function", "f", 0.5), ("r2", 1, "load", "a.load", "function", "f", 0.5), ("r3", 1, "load", "z.load", "function", "f", 0.9), ("r2", 2, "loader", "b.loader", "class", "f", 0.7)], "root string, id long, name string, qualified_name string, kind string, file_path string, pagerank_score double")
    roots = spark.createDataFrame([("r1", True), ("r2", True), ("r3", False)], "root string, enabled boolean")
    page = lambda **k: [(r["root"], r["qualified_name"]) for r in federated.workspace_search(symbols, roots, "load", **k).collect()]
    assert page() == [("r2", "b.loader"), ("r1", "a.load"), ("r2", "a.load")]
    assert page(limit=1, offset=1) == [("r1", "a.load")] and page(kind="class") == [("r2", "b.loader")]


def test_artifacts_with_their_schema(spark):
    text = '{"artifact_id": "x", "symbols": [{"qualified_name": "m.f", "start_line": 3}], "edges": [{"source": {"qualified_name": "m.f"}, "confidence": 0.5}], "more": 1}'
    found = sync.read_artifacts(spark.createDataFrame([(text,), ("no json",), (None,)], "payload string"))
    tables = sync.artifact_tables(found)
    assert found.count() == 1 and tables["symbols"].first()["start_line"] == 3 and tables["edges"].first()["source"]["qualified_name"] == "m.f"
