"""The tools by name: requests are checked and clamped, answers are plain dictionaries, results can be cached.

Data stays in DataFrames until an answer is formed; every answer is bounded by the guards.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import context, federated, metrics, search, walk
from graphloom.operators.rank import degrees


class ResultCache:
    """The latest answers by tool, snapshot version and request; old entries and old versions fall out."""

    def __init__(self, size: int = 1_024, seconds: float = 30.0, now: Callable[[], float] = time.monotonic) -> None:
        self.size, self.seconds, self.now = size, seconds, now
        self.entries: OrderedDict[str, tuple[float, Any]] = OrderedDict()

    def key(self, tool: str, version: int, payload: dict) -> str:
        return f"{tool}:{version}:{json.dumps(payload, sort_keys=True, default=str)}"

    def get(self, key: str) -> Any | None:
        found = self.entries.get(key)
        if found is None or self.now() - found[0] > self.seconds:
            self.entries.pop(key, None)
            return None
        self.entries.move_to_end(key)
        return found[1]

    def put(self, key: str, value: Any) -> None:
        self.entries[key] = (self.now(), value)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)


class CircuitBreaker:
    """Closed, open after ``threshold`` failures in a row, half open after ``reset`` seconds."""

    def __init__(self, threshold: int = 3, reset: float = 10.0, now: Callable[[], float] = time.monotonic) -> None:
        self.threshold, self.reset, self.now = threshold, reset, now
        self.failures, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.now() - self.opened >= self.reset else "open"

    def call(self, f: Callable[[], Any]) -> Any:
        if self.state == "open":
            raise RuntimeError("the circuit is open")
        try:
            out = f()
        except Exception:
            self.failures += 1
            if self.failures >= self.threshold or self.opened is not None:
                self.opened = self.now()
            raise
        self.failures, self.opened = 0, None
        return out


def artifact_checksum(payload: dict) -> str:
    """Of the canonical JSON without checksum and signature."""
    own = {k: v for k, v in payload.items() if k not in ("checksum", "signature")}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def payload_size(payload: dict) -> int:
    """Bytes of an answer as JSON."""
    return len(json.dumps(payload, default=str, separators=(",", ":")).encode())


#: The relationship that a reference is reported for (fixed values).
REASONS = {"callers": "CALLS", "callees": "CALLS", "implementors": "IMPLEMENTS", "supers": "EXTENDS"}


@dataclass
class Engine:
    """The tables of a snapshot and the tools over them. Plugins may have ``before_query`` and ``after_query``."""

    spark: SparkSession
    symbols: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    diagnostics: DataFrame | None = None
    version: int = 0
    cache: ResultCache = field(default_factory=ResultCache)
    plugins: list[Any] = field(default_factory=list)
    metrics: list[dict] = field(default_factory=list)

    def tools(self) -> dict[str, Callable[[dict], dict]]:
        return {n.removeprefix("tool_"): getattr(self, n) for n in dir(self) if n.startswith("tool_")}

    def call(self, tool: str, payload: dict) -> dict:
        """Plugins, cache, tool, plugins; a plugin's error is noted and the call goes on."""
        start, mode, failed = time.monotonic(), "miss", None
        payload = self._plug("before_query", tool, dict(payload))
        key = self.cache.key(tool, self.version, payload)
        out = self.cache.get(key)
        try:
            if out is not None:
                mode = "cache_hit"
            else:
                out = self.tools()[tool](payload)
                self.cache.put(key, out)
        except Exception as e:
            failed = str(e)
            raise
        finally:
            self.metrics.append({"tool_name": tool, "latency_ms": 1000 * (time.monotonic() - start), "success": failed is None, "mode": mode, "result_size": payload_size(out) if out is not None else 0, "error_message": failed})
        return self._plug("after_query", tool, out)

    def _plug(self, hook: str, tool: str, value: dict) -> dict:
        for p in self.plugins:
            if (f := getattr(p, hook, None)) is not None:
                try:
                    value = new if isinstance(new := f(tool, value), dict) else value
                except Exception as e:
                    self.metrics.append({"tool_name": f"plugin:{hook}", "latency_ms": 0.0, "success": False, "mode": "plugin", "error_message": str(e)})
        return value

    def _seeds(self, names: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(schema.truncate_query(n),) for n in names], "query string")
        return walk.resolve(self.symbols, asked).select(F.col("id").alias("seed_id"), "id").distinct()

    @staticmethod
    def _dicts(df: DataFrame, most: int = schema.MAX_EDGES) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.limit(most).collect()]

    def tool_search_symbols(self, p: dict) -> dict:
        limit, offset = schema.clamp(int(p.get("limit", 20)), schema.MAX_SEARCH_LIMIT), max(0, int(p.get("offset", 0)))
        rows = self._dicts(search.search_symbols(self.symbols, self.edges, p["query"], p.get("kind", "any"), p.get("file_pattern"), limit, offset))
        out = {"symbols": rows, "total_matches": len(rows), "pagination": {"offset": offset, "limit": limit, "returned": len(rows), "next_offset": offset + limit if len(rows) == limit and offset + limit < schema.MAX_SEARCH_LIMIT else None}}
        if p.get("include_explanations"):
            found: dict[str, int] = {}
            for r in rows:
                found[r["match_strategy"]] = found.get(r["match_strategy"], 0) + 1
            out["explanations"] = {"query": p["query"], "match_strategies": found}
        return out

    def tool_get_references(self, p: dict) -> dict:
        cap = schema.node_cap(self.symbols.count(), 200)
        rows = walk.references(self.spark, self.edges, self.symbols, self._seeds([p["symbol_name"]]), p.get("direction", "both"), int(p.get("depth", 1)), cap)
        if p.get("include_source") and self.files is not None:
            rows = walk.hydrate_source(rows, self.files)
        out: dict[str, list] = {n: [] for n in ("callers", "callees", "implementors", "supers")}
        for r in self._dicts(rows.orderBy("direction", "depth", "line", "id"), schema.edge_cap(cap)):
            out[r["direction"]].append({**r, "reference_reason": REASONS[r["direction"]]})
        return out

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Any SQL over the tables ``{symbols}`` and ``{edges}``, with bound arguments."""
        return self.spark.sql(text, args=args, symbols=self.symbols, edges=self.edges)

    def tool_get_blast_radius(self, p: dict) -> dict:
        schema.one_of(p.get("change_type", "behavior"), schema.CHANGE_TYPES, "change_type")
        seeds = self._seeds([p["symbol_name"]])
        found = walk.blast_radius(self.spark, self.edges, self.symbols, seeds, schema.clamp(int(p.get("max_depth", 3)), schema.MAX_DEPTH))
        summary = self._dicts(walk.blast_summary(self.symbols, seeds, found))
        return {"change_type": p.get("change_type", "behavior"), "impact": {"callers": self._dicts(found.orderBy("depth", "line", "id")), **(summary[0] if summary else {})}}

    def tool_change_impact(self, p: dict) -> dict:
        schema.one_of(p.get("change_type", "behavior"), schema.CHANGE_TYPES, "change_type")
        rows, summary = walk.change_impact(self.spark, self.edges, self.symbols, self._seeds([p["symbol_name"]]), int(p.get("max_depth", 3)), schema.node_cap(self.symbols.count()))
        own = self._dicts(summary)
        return {"change_type": p.get("change_type", "behavior"), "impact": {"dependents": self._dicts(rows.orderBy("impact_reason", "id")), **(own[0] if own else {})}}

    def tool_trace_data_flow(self, p: dict) -> dict:
        seeds = self._seeds([p["symbol_name"]])
        paths = walk.data_flow(self.spark, self.edges, self.symbols, seeds, p.get("direction", "both"), int(p.get("max_depth", 3)))
        return {"paths": self._dicts(paths.orderBy("depth", "line", "from_id", "to_id")), "nodes": self._dicts(walk.flow_nodes(paths, seeds, self.symbols).orderBy("file_path", "name", "id"))}

    def tool_get_context(self, p: dict) -> dict:
        budget = schema.clamp(int(p.get("token_budget", 8_000)), schema.MAX_BUDGET)
        seeds = search.pick_seeds(self.symbols, schema.truncate_query(p["query"]), p.get("entry_points")).select(F.lit(0).cast("bigint").alias("seed_id"), "id")
        if seeds.isEmpty():
            return {"summary": "No relevant symbols found.", "symbols": [], "tokens_used": 0, "token_budget": budget}
        rows = context.get_context(self.spark, self.symbols, self.edges, seeds, p["query"], self.files, budget, bool(p.get("include_signatures_only", False)), int(p.get("expansion_depth", 2)))
        own = self._dicts(rows.orderBy("position"), schema.MAX_VISITED)
        quality = self._dicts(context.quality(rows, seeds, budget))
        return {"summary": f"Selected {len(own)} symbols from {len({r['file_path'] for r in own})} files.", "relationship_map": " -> ".join(r["name"] for r in own[:8]), "symbols": own, "tokens_used": sum(r["tokens"] for r in own), "token_budget": budget, "quality_metrics": quality[0] if quality else {}}

    def tool_estimate_context_size(self, p: dict) -> dict:
        out = self.tool_get_context({**p, "include_signatures_only": True})
        return {"estimated_tokens": out["tokens_used"], "token_budget": out["token_budget"], "fits": out["tokens_used"] <= out["token_budget"]}

    def tool_get_context_summary(self, p: dict) -> dict:
        out = self.tool_get_context({**p, "include_signatures_only": True})
        modules: dict[str, dict] = {}
        for r in sorted(out["symbols"], key=lambda r: (r["file_path"], r["start_line"], r["id"])):
            own = modules.setdefault(r["file_path"], {"kinds": {}, "names": []})
            own["kinds"][r["kind"]] = own["kinds"].get(r["kind"], 0) + 1
            own["names"] = (own["names"] + [r["name"]])[:8]
        return {"modules": modules, "tokens_used": out["tokens_used"]}

    def tool_get_structure(self, p: dict) -> dict:
        lines = context.structure(self.symbols, p.get("path", "."), int(p.get("token_budget", 4_000)), bool(p.get("include_signatures", True)), bool(p.get("ranked", False)))
        return {"structure": context.structure_text(lines)}

    def tool_get_entry_points(self, p: dict) -> dict:
        return {"entry_points": self._dicts(search.entry_points(self.symbols, self.edges, int(p.get("limit", 20)), bool(p.get("include_tests", False))))}

    def tool_get_hot_paths(self, p: dict) -> dict:
        return {"hot_paths": self._dicts(search.hot_paths(self.symbols, self.edges, int(p.get("limit", 20)), bool(p.get("include_tests", False))))}

    def tool_get_orphan_symbols(self, p: dict) -> dict:
        found = search.orphans(self.symbols, self.edges, bool(p.get("include_tests", False)))
        return {"orphan_symbols": self._dicts(found.orderBy("file_path", "qualified_name").limit(max(1, int(p.get("limit", 50))))), "total_orphans": found.count()}

    def tool_get_indexing_diagnostics(self, p: dict) -> dict:
        rows = self.diagnostics if self.diagnostics is not None else self.spark.createDataFrame([], schema.DIAGNOSTICS)
        found = metrics.recent(rows, schema.clamp(int(p.get("limit", 50)), 500), int(p.get("offset", 0)), run_id=p.get("run_id"), stage=p.get("stage"), severity=p.get("severity"))
        return {"diagnostics": self._dicts(found), "summary": self._dicts(metrics.diagnostics_summary(rows))}

    def tool_get_server_status(self, p: dict) -> dict:
        counts = {"symbols": self.symbols.count(), "edges": self.edges.count(), "version": self.version}
        if not self.metrics:
            return {**counts, "tools": []}
        rows = self.spark.createDataFrame([(i, m["tool_name"], m["latency_ms"], m["success"], m["mode"]) for i, m in enumerate(self.metrics[-200:])], "id long, tool_name string, latency_ms double, success boolean, mode string")
        return {**counts, "tools": self._dicts(metrics.tool_summary(rows, ["tool_name"]).orderBy("tool_name"))}

    def tool_explain_symbol(self, p: dict) -> dict:
        seeds = self._seeds([p["symbol_name"]]).select("id")
        own = degrees(self.symbols.join(seeds, "id", "left_semi"), self.edges)
        near = metrics.explain_symbol(self.symbols, self.edges.join(seeds.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(self.edges.join(seeds.withColumnRenamed("id", "target_id"), "target_id", "left_semi")).distinct())
        return {"symbol": self._dicts(own), "neighbours": self._dicts(near.join(seeds, "id", "left_semi").orderBy("way", "place"))}


@dataclass
class Federation:
    """Tools over many repositories in one table each; a repository column is in every key."""

    spark: SparkSession
    symbols: DataFrame
    edges: DataFrame
    cross: DataFrame
    shards: DataFrame

    def search_symbols(self, query: str, kind: str = "any", limit: int = 20, only: list[str] | None = None) -> dict:
        asked = federated.enabled(self.shards)
        if only:
            asked = asked.where(F.col("repo_id").isin(only))
        found = federated.federated_search(self.symbols, self.edges, query, kind, limit, asked)
        return {"symbols": Engine._dicts(found), "shards": sorted(r["repo_id"] for r in asked.select("repo_id").collect())}

    def routes(self, name: str, source: str | None = None) -> list[str]:
        exported = federated.exported_symbols(self.symbols)
        return [r["repo_id"] for r in federated.route(exported, self.cross, self.shards, name, source).collect()]

    def symbol_routes(self, name: str) -> list[str]:
        exported = federated.exported_symbols(self.symbols)
        return [r["repo_id"] for r in federated.route_symbol(exported, self.shards, name).orderBy("place").collect()]

    def _one(self, repo: str) -> Engine:
        own = F.col("repo_id") == repo
        return Engine(self.spark, self.symbols.where(own), self.edges.where(own))

    def _each(self, name: str, tool: str, payload: dict, cross: bool) -> dict:
        out: dict[str, Any] = {"shards": {}, "errors": {}}
        for repo in self.routes(name):  # at most the shard cap
            try:
                out["shards"][repo] = self._one(repo).call(tool, payload)
            except Exception as e:
                out["errors"][repo] = str(e)
        if cross:
            hit = (F.col("source_qualified_name") == name) | (F.col("target_qualified_name") == name)
            out["cross_repo_edges"] = Engine._dicts(self.cross.where(hit).orderBy(*federated.CROSS_KEY), schema.MAX_CROSS_EDGES)
        return out

    def get_references(self, name: str, direction: str = "both", depth: int = 1, include_cross_repo: bool = True) -> dict:
        return self._each(name, "get_references", {"symbol_name": name, "direction": direction, "depth": depth}, include_cross_repo)

    def get_blast_radius(self, name: str, max_depth: int = 3, include_cross_repo: bool = True) -> dict:
        return self._each(name, "get_blast_radius", {"symbol_name": name, "max_depth": max_depth}, include_cross_repo)

    def cross_repo_edges(self, repo: str, direction: str = "both", limit: int = schema.MAX_CROSS_EDGES) -> list[dict]:
        return Engine._dicts(federated.cross_edges(self.cross, repo, direction, limit))

    def shard_status(self) -> list[dict]:
        return Engine._dicts(federated.shard_report(self.symbols, self.edges).orderBy("repo_id"))

    def get_context(self, query: str, entry_points: list[str] | None = None, token_budget: int = 8_000) -> dict:
        """The bundle of each repository that exports an entry point, in the order of the points; of all without any."""
        routed = list(dict.fromkeys(r for e in entry_points or [] for r in self.symbol_routes(e)))
        repos = routed or [r["repo_id"] for r in federated.enabled(self.shards).collect()]
        payload = {"query": query, "entry_points": entry_points or [], "token_budget": token_budget}
        return {r: self._one(r).call("get_context", payload) for r in repos[: schema.MAX_SHARDS]}

    def search_workspace_symbols(self, query: str, kind: str = "any", limit: int = 20, offset: int = 0) -> dict:
        """A page over all enabled roots."""
        roots = self.shards.withColumnRenamed("repo_id", "root")
        rows = Engine._dicts(federated.workspace_search(self.symbols.withColumnRenamed("repo_id", "root"), roots, query, kind, limit, offset))
        limit, offset = schema.clamp(limit, schema.MAX_SEARCH_LIMIT), max(0, offset)
        return {"symbols": rows, "pagination": {"offset": offset, "limit": limit, "returned": len(rows), "next_offset": offset + limit if len(rows) == limit else None}}

    def workspace_status(self) -> list[dict]:
        """Counts by repository, and over all under no name."""
        report = federated.shard_report(self.symbols, self.edges)
        return Engine._dicts(metrics.totals(report, "repo_id", ["symbols", "edges"]).orderBy(F.col("repo_id").asc_nulls_last()))

    def tools(self) -> dict[str, Callable[..., Any]]:
        return {
            "federated_search_symbols": self.search_symbols,
            "federated_get_references": self.get_references,
            "federated_get_blast_radius": self.get_blast_radius,
            "federated_get_context": self.get_context,
            "get_cross_repo_edges": self.cross_repo_edges,
            "get_shard_status": self.shard_status,
            "search_workspace_symbols": self.search_workspace_symbols,
            "get_workspace_status": self.workspace_status,
        }
