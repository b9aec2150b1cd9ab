"""Artifacts between a repository and a control plane: signing, compatibility, transport, and a client that never
stops local work: whatever fails is reported and answered from the local state.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.api import CircuitBreaker, artifact_checksum
from graphloom.tables import upsert

SCHEMA_VERSION = 1
#: What an artifact's JSON holds.
ENDS = "struct<qualified_name:string,file_path:string>"
ARTIFACT = (
    "artifact_id string, repo_id string, snapshot_id string, parent_snapshot string, tool_version string, schema_version int, created_at string, "
    "symbols array<struct<qualified_name:string,name:string,kind:string,file_path:string,start_line:int,end_line:int,signature:string>>, "
    f"edges array<struct<source:{ENDS},target:{ENDS},relationship:string,line_number:int,confidence:double>>, checksum string, signature string"
)


def read_artifacts(payloads: DataFrame) -> DataFrame:
    """Artifacts of JSON texts (column payload), with their declared types; a malformed text is left out."""
    parsed = payloads.select(F.from_json("payload", ARTIFACT, {"mode": "PERMISSIVE"}).alias("a")).select("a.*")
    return parsed.where("artifact_id IS NOT NULL")


def artifact_tables(artifacts: DataFrame) -> dict[str, DataFrame]:
    """The symbols and edges of artifacts as rows."""
    return {n: artifacts.select("artifact_id", F.explode(n).alias("r")).select("artifact_id", "r.*") for n in ("symbols", "edges")}


def canonical(payload: dict, *without: str) -> str:
    return json.dumps({k: v for k, v in payload.items() if k not in without}, sort_keys=True, separators=(",", ":"))


def sign(payload: dict, key: str) -> dict:
    """The payload with its checksum and an HMAC-SHA256 signature over all but the signature."""
    whole = {**payload, "checksum": artifact_checksum(payload)}
    return {**whole, "signature": hmac.new(key.encode(), canonical(whole, "signature").encode(), hashlib.sha256).hexdigest()}


def verified(payload: dict, key: str | None) -> str:
    """``ok``, or what is wrong with the checksum or, if a key is given, with the signature."""
    if payload.get("checksum") != artifact_checksum(payload):
        return "checksum_mismatch"
    if key is not None:
        want = hmac.new(key.encode(), canonical(payload, "signature").encode(), hashlib.sha256).hexdigest()
        if not hmac.compare_digest(want, payload.get("signature") or ""):
            return "signature_mismatch"
    return "ok"


def safe_key(text: str) -> str:
    """A name for a folder or file."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", text)[:80] + "-" + hashlib.sha256(text.encode()).hexdigest()[:12]


def compatible(artifact: dict, repo: str, snapshot: str, parent: str | None, tool_version: str) -> str:
    """``ok`` or why an artifact can't be used: repository, schema, major version, lineage."""
    if artifact.get("repo_id") != repo:
        return "repo_mismatch"
    if artifact.get("schema_version") != SCHEMA_VERSION:
        return "artifact_schema_mismatch"
    if str(artifact.get("tool_version", "")).split(".")[0] != tool_version.split(".")[0]:
        return "artifact_tool_mismatch"
    ours = {snapshot, *([parent] if parent else [])}
    theirs = {artifact.get("snapshot_id"), *([artifact["parent_snapshot"]] if artifact.get("parent_snapshot") else [])}
    return "ok" if ours & theirs else "lineage_mismatch"


@dataclass
class FileTransport:
    """JSON payloads below a root on any file system that Spark reads; the newest one counts."""

    spark: SparkSession
    root: str

    def _folder(self, repo: str, kind: str) -> str:
        return f"{self.root.rstrip('/')}/{safe_key(repo)}/{kind}"

    def push(self, repo: str, kind: str, payload: dict) -> None:
        row = [(payload.get("created_at") or "", json.dumps(payload, sort_keys=True))]
        self.spark.createDataFrame(row, "created_at string, payload string").coalesce(1).write.mode("append").json(self._folder(repo, kind))

    def latest(self, repo: str, kind: str) -> dict | None:
        try:
            found = self.spark.read.schema("created_at string, payload string").json(self._folder(repo, kind)).agg(F.max_by("payload", "created_at")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return json.loads(found) if found else None


@dataclass
class HttpTransport:
    """JSON payloads to and from a control plane: POST to push, GET of the latest one."""

    url: str
    seconds: float = 10.0

    def _place(self, repo: str, kind: str, *more: str) -> str:
        return "/".join([self.url.rstrip("/"), quote(repo, safe=""), kind, *more])

    def push(self, repo: str, kind: str, payload: dict) -> None:
        data = json.dumps(payload, sort_keys=True).encode()
        asked = Request(self._place(repo, kind), data=data, headers={"Content-Type": "application/json"}, method="POST")
        with urlopen(asked, timeout=self.seconds):
            pass

    def latest(self, repo: str, kind: str) -> dict | None:
        try:
            with urlopen(self._place(repo, kind, "latest"), timeout=self.seconds) as found:
                return json.loads(found.read())
        except HTTPError as e:
            if e.code == 404:
                return None
            raise


@dataclass
class SyncClient:
    """Push and pull with a time limit, a circuit breaker, a quarantine and pins."""

    transport: FileTransport | HttpTransport
    repo: str
    tool_version: str = "1.0"
    key: str | None = None
    seconds: float = 30.0
    breaker: CircuitBreaker = field(default_factory=CircuitBreaker)
    quarantine: dict[str, str] = field(default_factory=dict)
    pins: dict[str, str] = field(default_factory=dict)

    def _guarded(self, f: Callable[[], object]) -> tuple[bool, object]:
        pool = ThreadPoolExecutor(1)
        try:
            return True, self.breaker.call(lambda: pool.submit(f).result(self.seconds))
        except FutureTimeout:
            return False, "timeout"
        except RuntimeError as e:
            return False, "circuit_open" if self.breaker.state == "open" and "circuit" in str(e) else f"error: {e}"
        except Exception as e:
            return False, f"error: {e}"
        finally:
            pool.shutdown(wait=False)

    def push_delta(self, delta: dict) -> dict:
        if delta.get("schema_version") != SCHEMA_VERSION:
            return {"ok": False, "mode": "local_fallback", "reason": "delta_schema_mismatch"}
        ok, what = self._guarded(lambda: self.transport.push(self.repo, "deltas", sign(delta, self.key or "")))
        return {"ok": ok, "mode": "remote" if ok else "local_fallback", "reason": "ok" if ok else what}

    def pull_artifact(self, snapshot: str, parent: str | None = None) -> dict:
        ok, found = self._guarded(lambda: self.transport.latest(self.repo, "artifacts"))
        if not ok or found is None:
            return {"ok": False, "mode": "local_fallback", "reason": found if not ok else "no_artifact"}
        name = found.get("artifact_id", "")
        if name in self.quarantine:
            return {"ok": False, "mode": "local_fallback", "reason": "quarantined"}
        for why in (compatible(found, self.repo, snapshot, parent, self.tool_version), verified(found, self.key)):
            if why != "ok":
                if why.endswith("mismatch") and why.split("_")[0] in ("checksum", "signature"):
                    self.quarantine[name] = why
                return {"ok": False, "mode": "local_fallback", "reason": why}
        self.pins[snapshot] = name
        return {"ok": True, "mode": "remote", "reason": "ok", "artifact": found}

    def cycle(self, queue: list[dict], snapshot: str, parent: str | None = None) -> dict:
        """Pushes what waits, oldest first, until one fails, then pulls; gives the new states of the queue."""
        states = []
        for delta in queue:
            out = self.push_delta(delta)
            states.append("pushed" if out["ok"] else "retry")
            if not out["ok"]:
                states += ["queued"] * (len(queue) - len(states))
                break
        return {"queue": states, "pull": self.pull_artifact(snapshot, parent)}


def record(table: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Control tables: rows are appended, or put in the place of those with equal keys."""
    return table.unionByName(rows) if keys is None else upsert(table, rows, keys)


def breaker_of(table: DataFrame, repo: str) -> DataFrame:
    """The state of a repository's breaker; ``record(table, rows, ["repo_id"])`` sets it."""
    return table.where(F.col("repo_id") == repo)


def clear_run(diagnostics: DataFrame, run: str) -> DataFrame:
    """All but one run's rows."""
    return diagnostics.where(~F.col("run_id").eqNullSafe(F.lit(run)))


def active_keys(keys: DataFrame, inactive: bool = False) -> DataFrame:
    """K16."""
    return keys if inactive else keys.where("active")


def load_plugins(path: str) -> tuple[list[object], list[str]]:
    """Plugins of a JSON list of modules, and the errors of those that could not be loaded."""
    import importlib

    with open(path) as f:
        listed = json.load(f).get("plugins", [])
    found, errors = [], []
    for item in listed:
        if not item.get("enabled", True):
            continue
        try:
            module = importlib.import_module(item["module"])
            found.append(module.build_plugin() if hasattr(module, "build_plugin") else module)
        except Exception as e:
            errors.append(f"{item.get('module')}: {e}")
    return found, errors
