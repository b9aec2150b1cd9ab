import pytest

from graphloom import api
from graphloom.operators import change, federated, metrics, resolve
from graphloom.plans import index_job
from graphloom.sources import extract, files
from graphloom.streaming import watch

SOURCES = {
    "app/service.py": '''import os
from app.util import helper as h
from . import other

MAX_RETRIES = 3


class Service:
    """Runs."""

    def __init__(self, store: Store):
        self.store = store

    def run(self, n: int) -> str:
        self.stop()
        self.store.save(n)
        return h(n)

    def stop(self):
        pass


async def handler(x: str) -> str:
    s = Service(None)
    s.run(1)
    return x
''',
    "app/util.py": "def helper(n):\n    return n\n",
    "app/other.py": "class Store:\n    def save(self, n):\n        return helper(n)\n",
    "app/broken.py": "def (:\n",
    "src/AuthService.java": "package com.acme;\nimport com.acme.Base;\npublic class AuthService {\n    public static boolean login(String user, int n) {\n        return check(user);\n    }\n}\n",
    "com/acme/Base.java": "package com.acme;\npublic interface Base {\n}\n",
    "web/auth.ts": "import { token } from './token';\nexport interface AuthPort {}\nexport class AuthService {\n  async login(user: string): Promise<string> {\n    return token(user);\n  }\n}\nexport const makeToken = (n: number): string => `${n}`;\nexport function logout(): void {}\nexport const API_URL = 'x';\n",
    "web/token.ts": "export function token(u: string) { return u; }\n",
    "go/main.go": 'package main\n\nimport (\n\t"fmt"\n)\n\nconst MaxRetries = 3\n\ntype Service struct {}\ntype Reader interface {}\n\nfunc Login(user string) bool { return Verify(user) }\nfunc (s *Service) Verify(user string) bool { return true }\n',
    "notes.txt": "hello",
    ".env": "SECRET=1",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in SOURCES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture(scope="module")
def index(spark, tree):
    return index_job.full_index(spark, str(tree))


def test_scan(spark, tree):
    rows = {r["path"]: r for r in files.scan(spark, str(tree)).collect()}
    assert set(rows) == set(SOURCES) - {".env"}
    assert rows["web/auth.ts"]["language"] == "typescript" and rows["notes.txt"]["language"] is None
    assert files.scan(spark, str(tree), include=["*.py"], exclude=["app/broken.py"]).count() == 3
    assert files.rules(["# x", "", "./build/", "*.log"]) == ["build/", "*.log"]


def test_symbols(index):
    got = {(r["qualified_name"], r["kind"]): r for r in index.symbols.collect()}
    assert {("app.service.Service", "class"), ("app.service.Service.run", "method"), ("app.service.handler", "function"), ("app.service.MAX_RETRIES", "constant"), ("com.acme.AuthService", "class"), ("com.acme.AuthService.login", "method"), ("web.auth.AuthPort", "interface"), ("web.auth.AuthService.login", "method"), ("web.auth.makeToken", "function"), ("web.auth.logout", "function"), ("web.auth.API_URL", "constant"), ("main.Service", "class"), ("main.Reader", "interface"), ("main.Login", "function"), ("main.Service.Verify", "method"), ("main.MaxRetries", "constant")} <= set(got)
    assert got["app.service.handler", "function"]["is_async"] and got["app.service.handler", "function"]["return_type"] == "str"
    login = got["com.acme.AuthService.login", "method"]
    assert login["is_static"] and login["return_type"] == "boolean" and [(p["name"], p["type"]) for p in login["parameters"]] == [("user", "String"), ("n", "int")]
    assert got["app.service.Service", "class"]["docstring"] == "Runs." and got["com.acme.AuthService", "class"]["end_line"] == 7
    assert abs(sum(r["pagerank_score"] for r in got.values()) - 1) < 1e-6


def test_edges(index):
    names = {r["id"]: r["qualified_name"] for r in index.symbols.collect()}
    got = {(names[r["source_id"]], names[r["target_id"]], r["confidence"]) for r in index.edges.where("relationship = 'CALLS'").collect()}
    assert {("app.service.Service.run", "app.service.Service.stop", 1.0), ("app.service.Service.run", "app.other.Store.save", 1.0), ("app.service.Service.run", "app.util.helper", 1.0), ("app.service.handler", "app.service.Service.run", 1.0), ("app.other.Store.save", "app.util.helper", 1.0)} <= got
    imports = {(r["file_path"], r["line_number"]) for r in index.edges.where("relationship = 'IMPORTS'").collect()}
    assert ("app/service.py", 2) in imports and ("web/auth.ts", 1) in imports and ("src/AuthService.java", 2) in imports
    assert {r["module_name"] for r in index.external.collect()} >= {"os", "fmt"}
    assert [r["file_path"] for r in index.diagnostics.collect()] == ["app/broken.py"]


def test_incremental_equals_full(spark, tree, index):
    (tree / "app/util.py").write_text("def helper(n):\n    return twice(n)\n\n\ndef twice(n):\n    return n + n\n")
    (tree / "app/moved.py").write_text((tree / "app/other.py").read_text())
    (tree / "app/other.py").unlink()
    changes = spark.createDataFrame([("M", "app/util.py", None), ("R", "app/moved.py", "app/other.py")], "status string, path string, old_path string")
    step, whole = index_job.incremental_index(spark, index, str(tree), changes), index_job.full_index(spark, str(tree))
    assert index_job.stats(step) == index_job.stats(whole)
    assert change.same_edges(step.edges, whole.edges)
    key = ["qualified_name", "file_path", "start_line", "end_line"]
    assert step.symbols.select(key).exceptAll(whole.symbols.select(key)).isEmpty()


def test_call_strategies(spark):
    s = spark.createDataFrame([(1, "run", "m.A.run", "method", "a.py"), (2, "save", "m.A.save", "method", "a.py"), (3, "save", "n.Store.save", "method", "b.py"), (4, "save", "n.Other.save", "method", "c.py"), (5, "free", "x.free", "function", "x/free.py"), (6, "free", "y.free", "function", "y/free.py"), (7, "save", "n.store.save", "method", "d.py")], "id long, name string, qualified_name string, kind string, file_path string")
    calls = [("self", 1, "save", "self"), ("typed", 1, "save", "q"), ("alias", 1, "save", "al"), ("owner", 1, "save", "STORE"), ("same", 1, "save", "zz"), ("imported", 1, "free", None), ("none", 1, "nope", None)]
    c = spark.createDataFrame([(k, i, n, r, "a.py") for k, i, n, r in calls], "call_id string, caller_id long, callee string, receiver string, file_path string")
    rows = resolve.resolve_calls(c, s, spark.createDataFrame([("a.py", "al", "Other")], "file_path string, alias string, original string"), spark.createDataFrame([("typed", "n.Store")], "call_id string, hint string"), spark.createDataFrame([("a.py", "y.free")], "file_path string, hint string"))
    got = {}
    for r in rows.collect():
        got.setdefault(r["call_id"], []).append((r["target_id"], r["strategy"], r["confidence"]))
    assert {k: sorted(v) for k, v in got.items()} == {"self": [(2, "class_scoped", 1.0)], "typed": [(3, "typed", 0.84), (7, "typed", 0.84)], "alias": [(4, "alias_typed", 1.0)], "owner": [(7, "owner", 1.0)], "same": [(2, "same_file", 1.0)], "imported": [(6, "import_scoped", 1.0)]}


def test_imports(spark):
    rows = [(1, "pkg/a/b.py", "python", ".c"), (2, "pkg/a/b.py", "python", "..d"), (3, "pkg/a/b.py", "python", "pkg.d"), (4, "pkg/a/b.py", "python", "os"), (5, "X.java", "java", "com.acme.*"), (6, "web/x.ts", "typescript", "../lib"), (7, "web/x.ts", "typescript", "react"), (8, "g/x.go", "go", "example.com/mod/util"), (9, "g/x.go", "go", "fmt"), (10, "pkg/a/b.py", "python", "")]
    i = spark.createDataFrame(rows, "import_id long, file_path string, language string, module_name string")
    f = spark.createDataFrame([(p,) for p in ("pkg/a/c.py", "pkg/d/__init__.py", "com/acme/B.java", "com/acme/A.java", "lib/index.ts", "util/z.go", "util/a.go")], "path string")
    found, external = resolve.resolve_imports(i, f, "example.com/mod")
    assert {r["import_id"]: r["target_path"] for r in found.collect()} == {1: "pkg/a/c.py", 2: "pkg/d/__init__.py", 3: "pkg/d/__init__.py", 5: "com/acme/A.java", 6: "lib/index.ts", 8: "util/a.go"}
    assert {r["import_id"] for r in external.collect()} == {4, 7, 9, 10}


def test_git_lines_and_sidecars(spark, tmp_path):
    lines = spark.createDataFrame([(" M a.py",), ("?? b.py",), ("R  old.py -> new.py",), ("D  c.py",), ("AM d.py",), ("x",)], "value string")
    assert sorted(tuple(r) for r in files.git_status(lines).collect()) == [("A", "b.py", None), ("D", "c.py", None), ("M", "a.py", None), ("M", "d.py", None), ("R", "new.py", "old.py")]
    diff = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("A\tb.py",), ("junk",)], "value string")
    assert sorted(tuple(r) for r in files.git_diff(diff).collect()) == [("A", "b.py", None), ("M", "a.py", None), ("R", "new.py", "old.py")]
    hints = spark.createDataFrame([("a.py", 5, 7, "x", "T"), ("a.py", 1, 10_000, "y", "U")], "file_path string, line_start int, line_end int, receiver string, owner_type string")
    assert files.semantic_hints(hints).count() == 3 + 513
    (tmp_path / "s.json").write_text('{"a": "1", "b": "2"}')
    assert sorted(tuple(r) for r in files.snapshot(spark, str(tmp_path / "s.json")).collect()) == [("a", "1"), ("b", "2")]
    (tmp_path / "w.json").write_text('{"roots": [{"path": "/x/one"}, {"path": "/x/one", "enabled": true}, {"path": "/x/two", "enabled": false}]}')
    assert [r["path"] for r in files.workspace(spark, str(tmp_path / "w.json"), "/fallback").collect()] == ["/x/one"]
    (tmp_path / "m.jsonl").write_text('{"suite": "a", "n": 1}\nnot json\n{"suite": "b", "n": 2}\n')
    assert files.metrics_history(spark, str(tmp_path / "m.jsonl"), "suite string, n int").count() == 2


def test_deltas(spark):
    symbols = spark.createDataFrame([(1, "s", "m.s", "a.py"), (2, "t", "m.t", "b.py")], "id long, name string, qualified_name string, file_path string")
    edges = spark.createDataFrame([(1, 2, "symbol", "symbol", "CALLS", "a.py", 3, 0.9)], "source_id long, target_id long, source_type string, target_type string, relationship string, file_path string, line_number int, confidence double")
    listing = spark.createDataFrame([("a.py", "h", 5)], "path string, content_hash string, size_bytes long")
    changes = spark.createDataFrame([("M", "a.py", None)], "status string, path string, old_path string")
    delta = change.build_delta(changes, listing, symbols, edges)
    assert delta["edges"].first()["source"]["qualified_name"] == "m.s" and delta["quality"].first()[0] == 1.0
    assert change.promote(delta)[1] == "ambiguity" and change.promote(delta, parse_failures=1, max_ambiguity=1.0)[1] == "parse_failures"
    artifact, why = change.promote(delta, max_ambiguity=1.0)
    assert why == "promoted" and artifact["edges"].count() == 1
    assert change.reconcile(artifact, {"symbols": artifact["symbols"].limit(0), "edges": artifact["edges"].limit(0)}, change.touched_paths(changes))["edges"].count() == 0


def test_queue(spark):
    q = spark.createDataFrame([(1, "r", "queued", 0, None, 5), (2, "r", "retry", 1, None, 4), (3, "r", "pushed", 1, None, 1), (4, "x", "queued", 0, None, 1)], "id long, repo_id string, status string, attempt_count int, last_error string, created_at int")
    assert [r["id"] for r in change.pending(q, "r", 5).collect()] == [2, 1]
    done = change.marked(q, spark.createDataFrame([(1, "odd", "e"), (2, "pushed", None)], "id long, status string, last_error string"))
    assert {r["id"]: (r["status"], r["attempt_count"]) for r in done.collect()} == {1: ("retry", 1), 2: ("pushed", 2), 3: ("pushed", 1), 4: ("queued", 0)}


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 3)] + [("b", 7.0), ("c", None)], "k string, v double")
    got = {r["k"]: (r["p"], r["q"]) for r in metrics.index_percentiles(rows, ["k"], "v", {"p": 0.5, "q": 0.95}).collect()}
    assert got == {"a": (3.0, 5.0), "b": (7.0, 7.0)}


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("M", "a", None), ("M", "a", None), ("A", "b", None)], "status string, path string, old_path string").coalesce(1).write.parquet(folder)
    seen = []
    watch.watch(spark, folder, "status string, path string, old_path string", lambda df, n: seen.append(df.count())).awaitTermination()
    assert seen == [2]
    feed = str(tmp_path / "feed")
    for i, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", "9")], [("b", None)]]):
        spark.createDataFrame([(p, h, i) for p, h in rows], "path string, hash string, seq int").coalesce(1).write.mode("append").parquet(feed)
    got = []
    stream = spark.readStream.schema("path string, hash string, seq int").option("maxFilesPerTrigger", 1).parquet(feed)
    watch.stateful_diff(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(sorted(tuple(r) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == sorted([("a", "A"), ("b", "A"), ("a", "M"), ("c", "A"), ("b", "D")])


def test_tools(spark, index):
    engine = api.Engine(spark, index.symbols.cache(), index.edges.cache())
    assert {"search_symbols", "get_references", "get_context", "get_structure", "get_blast_radius", "trace_data_flow", "change_impact", "get_indexing_diagnostics", "get_server_status", "estimate_context_size", "get_context_summary", "get_entry_points", "get_hot_paths", "get_orphan_symbols"} <= set(engine.tools())
    assert engine.call("search_symbols", {"query": "handler", "include_explanations": True})["symbols"][0]["name"] == "handler"
    assert engine.call("search_symbols", {"query": "handler", "include_explanations": True}) and engine.metrics[-1]["mode"] == "cache_hit"
    assert sorted(r["name"] for r in engine.call("get_references", {"symbol_name": "helper", "direction": "callers"})["callers"]) == ["run", "save"]
    assert engine.call("get_references", {"symbol_name": "no such thing"}) == {"callers": [], "callees": [], "implementors": [], "supers": []}
    with pytest.raises(ValueError):
        engine.call("get_blast_radius", {"symbol_name": "helper", "change_type": "odd"})
    assert engine.call("get_blast_radius", {"symbol_name": "helper"})["impact"]["direct"] == 2
    assert engine.call("get_context", {"query": "helper", "token_budget": 50})["tokens_used"] <= 50
    assert engine.call("get_context", {"query": "!!"})["symbols"] == []
    assert "[rank:1]" in engine.call("get_structure", {})["structure"]
    assert engine.call("get_server_status", {})["symbols"] == index.symbols.count()
    assert engine.call("explain_symbol", {"symbol_name": "app.util.helper"})["symbol"][0]["inbound"] == 2

    class Plugin:
        def before_query(self, tool, payload):
            return {**payload, "limit": 1}

        def after_query(self, tool, out):
            raise RuntimeError("odd")

    engine.plugins.append(Plugin())
    assert len(engine.call("get_hot_paths", {})["hot_paths"]) == 1 and engine.metrics[-1]["tool_name"] == "plugin:after_query"


def test_cache_and_breaker():
    now = [0.0]
    cache = api.ResultCache(2, 10, lambda: now[0])
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 11
    assert cache.get("c") is None
    b = api.CircuitBreaker(2, 5, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        b.call(lambda: 1)
    now[0] = 17
    assert b.state == "half_open" and b.call(lambda: 5) == 5 and b.state == "closed"
    assert api.artifact_checksum({"b": 1, "a": 2, "checksum": "x"}) == api.artifact_checksum({"a": 2, "b": 1})


def test_federation(spark):
    symbols = spark.createDataFrame([("lib", 1, "helper", "lib.helper", "function", "lib/x.py", "def helper()", None, 0.5, 1, 2), ("app", 1, "main", "app.main", "function", "app/x.py", "def main()", None, 0.2, 1, 2)], "repo_id string, id long, name string, qualified_name string, kind string, file_path string, signature string, docstring string, pagerank_score double, start_line int, end_line int")
    edges = spark.createDataFrame([("lib", 1, 1, "symbol", "symbol", "CALLS", "lib/x.py", 1, 1.0)], "repo_id string, source_id long, target_id long, source_type string, target_type string, relationship string, file_path string, line_number int, confidence double")
    deps = spark.createDataFrame([("app", "app/x.py", "lib", "python"), ("lib", "lib/x.py", "lib", "python"), ("app", "w.ts", "@x/helper", "typescript")], "repo_id string, file_path string, module_name string, language string")
    cross = federated.resolve_external(deps, federated.exported_symbols(symbols)).cache()
    assert sorted((r["source_repo_id"], r["source_qualified_name"], r["target_qualified_name"]) for r in cross.collect()) == [("app", "@x/helper", "lib.helper"), ("app", "lib", "lib.helper")]
    f = api.Federation(spark, symbols, edges, cross, spark.createDataFrame([("lib", True), ("app", True), ("off", False)], "repo_id string, enabled boolean"))
    assert [r["name"] for r in f.search_symbols("help")["symbols"]] == ["helper"] and f.search_symbols("help", only=["app"])["symbols"] == []
    assert f.routes("lib.helper", "app") == ["app", "lib"]
    out = f.get_references("helper")
    assert set(out["shards"]) == {"lib"} and not out["errors"]
    assert list(f.get_context("helper", ["lib.helper"])) == ["lib"] and {"federated_search_symbols", "get_workspace_status"} <= set(f.tools())
    assert [(r["repo_id"], r["symbols"], r["edges"]) for r in f.workspace_status()] == [("app", 1, 0), ("lib", 1, 1), (None, 2, 1)]
    assert len(f.cross_repo_edges("lib", "in")) == 2 and [r["symbols"] for r in f.shard_status()] == [1, 1]


def test_extractors_on_odd_files():
    for language in ("python", "java", "typescript", "go", None):
        for text in (None, "", "\n", "}}}{{{", "\x00", "def f(:"):
            extract.extract_file("x", language, text)


JAVA = '''package com.acme;
import static java.util.List.*;
/* class No { */
@Service("x{")
public class Auth extends Base<String, Map<A, B>> {
    private final List<String> names = new ArrayList<>();
    int[] xs = {1, 2};
    public Auth(@Named("a") final String user) { this.user = user; }
    @Override
    public static <T> Map<String, T> login(
        String user, int... n) throws IOException {
        // if (foo) {
        Foo f = new Foo(); String s = "}";
        if (check(user)) { return f.go(1); }
        return null;
    }
    abstract int nobody(int a);
    interface Inner { default void x() { } }
}
'''
TYPESCRIPT = '''import { token as t, type Other } from './token';
import Def from "pkg";
export interface AuthPort { x(): void }
type Alias<T> = T | { a: string };
export default abstract class Auth<T> extends Base {
  private x = (a) => { return 1; };
  constructor(private readonly a: string) { super(); }
  async login(user: string, opts: { a: number } = {a: 1}, ...rest: any[]): Promise<Map<string, number>> {
    const c: Store = new Store(1);
    return token(user);
  }
  private static _s<T>(a?: number): { b: string } { return f(a); }
  abstract nobody(): void;
}
export const makeToken = async (n: number, g = (a, b) => 1): string => `${n} class X {`;
export function _logout<T>(a = 5): void {}
export const API_URL = 'x';
let v = new Foo.Bar();
'''
GO = '''package main
import (
	"fmt"
	m "math"
)
const MaxRetries = 3
type Service struct {
	x func(a int) int
}
func Login(user string, a, b int, rest ...string) bool { s := &Service{}; return Verify(user) }
func (s *Service) Verify(user string) (bool, error) { return true, nil }
func () odd() {}
var raw = `func Nope() {`
'''


def declared(language, text):
    rows = extract.extract_file("web/auth.x", language, text)
    return {(s["kind"], s["qualified_name"]): s for r, s, *_ in rows if r == "symbol"}, {tuple(r[2:]) for r in rows if r[0] in ("import", "alias", "assigned")}


def test_java_declarations():
    found, rest = declared("java", JAVA)
    assert set(found) == {("class", "com.acme.Auth"), ("method", "com.acme.Auth.Auth"), ("method", "com.acme.Auth.login"), ("interface", "com.acme.Inner"), ("method", "com.acme.Inner.x")}
    login = found["method", "com.acme.Auth.login"]
    assert (login["start_line"], login["end_line"], login["return_type"], login["visibility"], login["is_static"]) == (10, 10, "Map<String, T>", "public", True)
    assert [(p["name"], p["type"]) for p in login["parameters"]] == [("user", "String"), ("n", "int")]
    assert found["class", "com.acme.Auth"]["end_line"] == 19 and found["interface", "com.acme.Inner"]["visibility"] == "package"
    assert {(2, "import static java.util.List.*;", "java.util.List.*"), (6, "names", "List"), (6, "names", "ArrayList"), (13, "f", "Foo")} == rest


def test_typescript_declarations():
    found, rest = declared("typescript", TYPESCRIPT)
    kinds = {"interface": ["AuthPort", "Alias"], "class": ["Auth"], "method": ["Auth.login", "Auth._s"], "function": ["makeToken", "_logout"], "constant": ["API_URL"]}
    assert set(found) == {(k, f"web.auth.{n}") for k, names in kinds.items() for n in names}
    login = found["method", "web.auth.Auth.login"]
    assert login["is_async"] and login["return_type"] == "Promise<Map<string, number>>" and login["visibility"] == "public"
    assert [(p["name"], p["type"], p["default_value"]) for p in login["parameters"]] == [("user", "string", None), ("opts", "{ a: number }", "{a: 1}"), ("rest", "any[]", None)]
    assert found["function", "web.auth._logout"]["visibility"] == "public" and found["method", "web.auth.Auth._s"]["visibility"] == "private"
    assert {(1, "t", "token"), (1, "Other", "Other"), (2, "Def", "Def"), (9, "c", "Store"), (18, "v", "Foo.Bar")} <= rest


def test_go_declarations():
    found, rest = declared("go", GO)
    assert set(found) == {("constant", "main.MaxRetries"), ("class", "main.Service"), ("function", "main.Login"), ("method", "main.Service.Verify"), ("method", "main.Receiver.odd")}
    assert [(p["name"], p["type"], p["position"]) for p in found["function", "main.Login"]["parameters"]] == [("user", "string", 0), ("a", None, 1), ("b", "int", 2), ("rest", "string", 3)]
    assert found["method", "main.Service.Verify"]["return_type"] == "(bool, error)" and found["method", "main.Receiver.odd"]["visibility"] == "private"
    assert {(3, '"fmt"', "fmt"), (4, 'm "math"', "math"), (10, "s", "Service")} == rest
