import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import chat
from tests.oracle import DATA

PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "<|im_", "start|>", "\n", "a", "é", "😀", "", "", "<", "[", "/", "n"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "a\nb"]), PARTS), st.one_of(st.none(), PARTS)), max_size=6))
def test_round_trip(turns):
    out, start, size = chat.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    out.validate(full=True)
    for (role, text), part, s, n in zip(turns, out.to_pylist(), start.tolist(), size.tolist(), strict=True):
        raw = part.encode()
        assert chat.read_turn(raw) == ((role or "").encode(), (text or "").encode())
        assert chat.unescape(raw[s : s + n]) == (text or "").encode()
        inner = raw[len(chat.OPEN) : -len(chat.CLOSE)]
        assert not any(c.encode() in inner for c in chat.CONTROLS)


def digest(turns):
    said = b"".join(f"{r or ''}\n{t or ''}\n".encode() for r, t in turns)
    own = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said).hexdigest(), len(own), hashlib.sha256(own.encode()).hexdigest()


def test_contract(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").collect()
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op8_chat(spark, f"{DATA}/sf0.01").collect()}
    assert got == {k: digest(v) for k, v in by.items()}


def test_defined_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 0, "user", "x"), (2, 0, "assistant", "é" * 500000), (2, 0, "assistant", "é" * 500000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.format_turns(turns)).collect()}
    assert got[1] == digest([(None, "first"), ("user", None), ("assistant", ""), ("assistant", "b")])
    assert got[None] == digest([("user", "x")])
    assert got[2] == digest([("assistant", "é" * 500000)] * 2)
    assert chat.digests(chat.format_turns(spark.createDataFrame([], turns.schema))).count() == 0


def test_whole_conversation_is_its_parts_in_order(spark):
    rows = [(7, 2, "user", "c"), (7, 0, "user", "a"), (7, 1, "assistant", "b")]
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert "".join(r["formatted"] for r in out) == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert [r["loss_bytes"] for r in out] == [None, 1, None]
