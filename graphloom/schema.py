"""Declared schemas, enumerations and guards of the graph tables."""

from __future__ import annotations

from pyspark.sql import types as T

PARAMETERS = "array<struct<name:string,type:string,position:int,default_value:string>>"
FILES = "path string, language string, content_hash string, size_bytes bigint, last_indexed_at timestamp"
SYMBOLS = f"id bigint, name string, qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, return_type string, visibility string, is_async boolean, is_static boolean, parent_symbol_id bigint, docstring string, pagerank_score double, parameters {PARAMETERS}"
EDGES = "source_id bigint, target_id bigint, source_type string, target_type string, relationship string, file_path string, line_number int, confidence double"
EXTERNAL_DEPS = "file_path string, import_statement string, module_name string, line_number int"
DIAGNOSTICS = "id bigint, run_id string, stage string, category string, severity string, file_path string, language string, message string, hint string, created_at timestamp"
TOOL_METRICS = "id bigint, repo_id string, tool_name string, latency_ms double, success boolean, mode string, result_size bigint, error_message string, created_at timestamp"
SYNC_QUEUE = "id bigint, repo_id string, local_snapshot string, payload_json string, status string, attempt_count int, last_error string, created_at timestamp, updated_at timestamp"
CROSS_REPO_EDGES = "source_repo_id string, source_qualified_name string, source_file_path string, target_repo_id string, target_qualified_name string, target_file_path string, relationship string, confidence double, provenance string"
EXPORTED_SYMBOLS = "repo_id string, qualified_name string, name string, kind string, file_path string, visibility string, pagerank_score double"
CHANGES = "status string, path string, old_path string"

KINDS = frozenset({"function", "class", "method", "interface", "constant", "any"})
DIRECTIONS = frozenset({"callers", "callees", "both", "implementors", "supers"})
FLOWS = frozenset({"upstream", "downstream", "both"})
CHANGE_TYPES = frozenset({"signature", "behavior", "delete"})
#: Relationships that context expansion follows (fixed values).
RELATIONSHIPS = ("CALLS", "IMPORTS_SYMBOL", "EXTENDS", "IMPLEMENTS", "HAS_METHOD")

#: Guards (fixed values).
MAX_QUERY_BYTES = 512
MAX_SEARCH_LIMIT = 100
MAX_DEPTH = 6
MAX_CONTEXT_DEPTH = 4
MAX_BUDGET = 32_000
MAX_VISITED = 2_000
MAX_EDGES = 5_000
MAX_SEEDS = 32
MAX_SHARDS = 16
MAX_CROSS_EDGES = 200
MAX_FEDERATED = 500


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def one_of(value: str, allowed: frozenset[str], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {sorted(allowed)}, not {value!r}")
    return value


def clamp(value: int, most: int, least: int = 1) -> int:
    return max(least, min(most, value))


def truncate_query(text: str) -> str:
    """At most 512 bytes, cut at a character's border."""
    return text.encode()[:MAX_QUERY_BYTES].decode(errors="ignore")


def node_cap(symbols: int, floor: int = 128) -> int:
    """A fifth of the symbols, within the floor and the guard."""
    return clamp(max(floor, symbols // 5), MAX_VISITED, floor)


def edge_cap(nodes: int) -> int:
    return max(256, min(MAX_EDGES, 2 * nodes))
