import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat_format as c

from .conftest import SF

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<|image:0|>", "<", "/s>", "\\", "|", "INST]", "a", "é", "\n", "<<SYS>>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_round_trip(turns):
    formatted = [c.format_turn(r, [{"kind": "text", "text": t}]) for r, t in turns]
    assert c.parse_turns("".join(f["formatted"] for f in formatted)) == turns
    for (_, t), f in zip(turns, formatted, strict=True):
        body = c.escape(t)
        assert not any(x in body for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def test_parts_are_visited_in_order():
    parts = [{"kind": "text", "text": "see <|image:0|> "}, {"kind": "image", "ref": "a.png", "units": 2}, {"kind": "audio", "ref": "b.wav", "units": 4}, None, {"kind": "scan", "ref": "c.pdf"}, {"kind": "text", "text": None}]
    out = c.format_turn("user", parts)
    assert out["formatted"] == "<s>[INST]user[/INST]see <\\|image:0|> <|image:0|><|audio:1|><|document:2|></s>"
    assert out["attachments"] == [{"position": 0, "kind": "image", "ref": "a.png", "tokens": 512}, {"position": 1, "kind": "audio", "ref": "b.wav", "tokens": 100}, {"position": 2, "kind": "document", "ref": "c.pdf", "tokens": 512}]
    assert out["loss_start"] == out["loss_end"]


def test_query_against_brute_force(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    rows[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for k, own in rows.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        want[k] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in c.op1_chat_format(spark, SF).collect()}
    assert got == want


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, None, None, None), (2, None, "assistant", "é\U0001f600"), (2, 5, "tool", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_start int")
    got = {r["conv_id"]: r for r in c.read_back(c.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"assistant\nb\nassistant\nb\nuser\n\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert got[2]["loss_chars"] == 2 and got[2]["n_turns"] == 2
    assert c.read_back(c.format_conversations(df.limit(0))).count() == 0


def test_a_column_of_the_name_parts_without_parts_is_ignored(spark):
    plain = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    named = plain.withColumn("parts", F.lit(5)).withColumn("formatted", F.lit("x"))
    assert sorted(c.format_conversations(named).collect()) == sorted(c.format_conversations(plain).collect())
