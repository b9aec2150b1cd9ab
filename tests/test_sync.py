import json

from graphloom import sync
from graphloom.api import CircuitBreaker


def artifact(**more):
    return {"artifact_id": "a1", "repo_id": "r", "schema_version": 1, "tool_version": "1.4", "snapshot_id": "s1", "parent_snapshot": "s0", "created_at": "2024", "symbols": [], **more}


def test_signatures():
    signed = sync.sign(artifact(), "k")
    assert sync.verified(signed, "k") == sync.verified(signed, None) == "ok"
    assert sync.verified({**signed, "symbols": [1]}, "k") == "checksum_mismatch" and sync.verified(signed, "other") == "signature_mismatch"
    assert sync.safe_key("a/b c") != sync.safe_key("a_b_c")


def test_compatibility():
    ok = lambda **m: sync.compatible(artifact(**m), "r", "s1", None, "1.0")
    assert [ok(), ok(repo_id="x"), ok(schema_version=2), ok(tool_version="2.0"), ok(snapshot_id="z"), ok(snapshot_id="s2", parent_snapshot="s1")] == ["ok", "repo_mismatch", "artifact_schema_mismatch", "artifact_tool_mismatch", "lineage_mismatch", "ok"]


def test_client(spark, tmp_path):
    transport = sync.FileTransport(spark, str(tmp_path))
    client = sync.SyncClient(transport, "r", key="k")
    assert client.pull_artifact("s1")["reason"] == "no_artifact"
    assert client.push_delta({"schema_version": 9})["reason"] == "delta_schema_mismatch"
    transport.push("r", "artifacts", sync.sign(artifact(), "k"))
    transport.push("r", "artifacts", sync.sign(artifact(artifact_id="old", created_at="2020"), "k"))
    out = client.cycle([{"schema_version": 1, "created_at": "1"}], "s1")
    assert out["queue"] == ["pushed"] and out["pull"]["artifact"]["artifact_id"] == "a1" and client.pins == {"s1": "a1"}
    transport.push("r", "artifacts", {**sync.sign(artifact(artifact_id="bad", created_at="2025"), "k"), "symbols": [1]})
    assert client.pull_artifact("s1")["reason"] == "checksum_mismatch" and client.pull_artifact("s1")["reason"] == "quarantined"


def test_breaker_keeps_local_work_going():
    class Broken:
        def push(self, *a):
            raise OSError("down")

    client = sync.SyncClient(Broken(), "r", breaker=CircuitBreaker(2, 100))
    reasons = [client.push_delta({"schema_version": 1})["reason"] for _ in range(3)]
    assert reasons[0].startswith("error") and reasons[2] == "circuit_open"


def test_control_tables(spark, tmp_path):
    rows = spark.createDataFrame([("r", "s", "a")], "repo string, snapshot string, artifact string")
    assert sync.record(rows, spark.createDataFrame([("r", "s", "b")], rows.schema), ["repo", "snapshot"]).first()["artifact"] == "b"
    assert sync.record(rows, rows).count() == 2
    runs = spark.createDataFrame([("x",), ("y",), (None,)], "run_id string")
    assert sync.clear_run(runs, "x").count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"plugins": [{"module": "json"}, {"module": "no_such_module_here"}, {"module": "re", "enabled": False}]}))
    found, errors = sync.load_plugins(str(tmp_path / "p.json"))
    assert len(found) == 1 and len(errors) == 1
