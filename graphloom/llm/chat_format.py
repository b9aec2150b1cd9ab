"""Chat formatting: turns of typed content parts become one trainable text, and can be read back from it.

A visitor walks the parts of a turn in order. Text is escaped; an image, audio or document part becomes an ordered
placeholder, whose attachment reference and expanded token count are recorded beside the text. A formatted turn is

    <s>[INST]role[/INST]body</s>

and a conversation is its formatted turns one after the other. In roles and texts a backslash is doubled, and one is
put behind the first character of anything that starts like a control string, so no control string of the
template is ever part of a text and unescaping is exact.

Defined results: a null text or part list is an empty body; a null role is an empty role; a part of unknown kind
is a document part; a part without units costs what its kind costs by default; turns with equal numbers are ordered
by role and text, null first; repeated rows are turns of their own; extra columns are ignored, and so is one named
parts that holds no typed parts; no rows give no conversations. Conversations and texts of any length are read as a stream of sorted rows, so a hot one never is in memory at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of the template (fixed values).
OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What starts like a control string or a placeholder.
_CONTROL = re.compile(r"\\|[<\[](?=/?s>|/?INST\]|<?/?SYS>>|\|)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(HEAD_END) + "(.*?)" + re.escape(CLOSE), re.DOTALL)

PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("ref", T.StringType()),
            T.StructField("units", T.LongType()),
        ]
    )
)
ATTACHMENTS = "array<struct<position:int,kind:string,ref:string,tokens:bigint>>"
FORMATTED = f"conv_id bigint, turn bigint, order_role string, order_text string, formatted string, loss_start int, loss_end int, attachments {ATTACHMENTS}"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """Inverse of ``escape``."""
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        if text[j + 1 : j + 2] == "\\":
            out.append("\\")
            i = j + 2
        else:
            i = j + 1
    out.append(text[i:])
    return "".join(out)


@dataclass
class PartVisitor:
    """Flattens the parts of one turn. Token costs: of an image tile, an audio frame and a document page."""

    image_tokens: int = 256
    audio_tokens: int = 25
    document_tokens: int = 512
    body: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.image_tokens)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.audio_tokens)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.document_tokens)

    def _attach(self, kind: str, part: dict, cost: int) -> None:
        units = part.get("units")
        position = len(self.attachments)
        self.body.append(f"<|{kind}:{position}|>")
        self.attachments.append({"position": position, "kind": kind, "ref": part.get("ref"), "tokens": cost * (1 if units is None else max(0, units))})


def format_turn(role: str | None, parts: list[dict] | None, loss_roles: frozenset[str] = frozenset({"assistant"})) -> dict:
    """One turn's text, the span of it under the loss mask (empty for other roles), and its attachments."""
    visitor = PartVisitor()
    for part in parts or ():
        visitor.visit(part or {})
    head = OPEN + escape(role or "") + HEAD_END
    body = "".join(visitor.body)
    end = len(head) + len(body) if role in loss_roles else len(head)
    return {"formatted": head + body + CLOSE, "loss_start": len(head), "loss_end": end, "attachments": visitor.attachments}


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; attachments stay placeholders in the text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _has_parts(conversations: DataFrame) -> bool:
    """Whether a column ``parts`` holds typed parts; one of another type is an extra column."""
    kind = {f.name: f.dataType for f in conversations.schema.fields}.get("parts")
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and kind.elementType.names == PARTS.elementType.names


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted turns of ``conversations`` (conv_id, turn, role, and ``parts`` or ``text``); row by row, no shuffle."""
    body = F.col("parts").cast(PARTS) if _has_parts(conversations) else F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), body.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("formatted", "loss_start", "loss_end", "attachments")}
            roles, parts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for role, own in zip(roles, parts, strict=True):
                for k, v in format_turn(role, own).items():
                    out[k].append(v)
            texts = ["".join(p.get("text") or "" for p in own or () if p) for own in parts]
            kinds = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            columns = [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(out["formatted"], pa.string()), pa.array(out["loss_start"], pa.int32()), pa.array(out["loss_end"], pa.int32()), pa.array(out["attachments"], kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "order_role", "order_text", "formatted", "loss_start", "loss_end", "attachments"])

    return rows.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted turns in order.

    Rows meet by conversation, sorted, and are read as a stream: only running digests are held.
    """
    digest = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachments", pa.int64()), ("attachment_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6], s[7])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in digest]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, digest, strict=True)], schema=digest)

        for batch in batches:
            for conv, text, start, end, attached in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, body in parse_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                learned = unescape(text[start:end])
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(text)
                state[6] += len(attached or ())
                state[7] += sum(a["tokens"] for a in attached or ())
            if len(done) >= 5_000:
                yield flush()
                done = []
        if state is not None:
            done.append(close(state))
        yield flush()

    ordered = (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "order_role", "order_text")
        .select("conv_id", "formatted", "loss_start", "loss_end", "attachments")
    )
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attachments bigint, attachment_tokens bigint")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(probe)))
