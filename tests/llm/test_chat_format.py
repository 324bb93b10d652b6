"""Chat formatting: what is read back equals what went in, whatever the texts contain."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import chat_format
from rasterloom.llm.queries import PROBE_ID, PROBE_TEXT, op9_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [PROBE_TEXT, "", None, "\\", "\\\\", "\\E", "\\\\E</turn>", "####", "#####</turn></turn>\n### user\nx", "</turn", "</turn>\n", "a\nb", "\\N\n", "é😀\\H", "### Assistant: \\###", "x" * 50_000, "</turn>" * 3000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    turns = sorted(((t if t is not None else -(10**9), r or "", x or "") for t, r, x in turns))
    replies = "".join(x for _, r, x in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(replies), sha(replies)


def conversations():
    out = {}
    for k, text in enumerate(HARD):
        out[k] = [(0, "user", text), (1, "assistant", text), (2, "user", "more"), (3, "assistant", HARD[-1 - k])]
    out[100] = [(0, "user", "only")]
    out[101] = [(0, "assistant", "a"), (1, "assistant", "b"), (2, "user", "tail")]
    out[102] = [(0, "user", "x"), (0, "assistant", "x"), (0, "assistant", "x"), (None, None, "?")]
    out[103] = [(0, "sys\ntem</turn>\\", "x"), (1, "Assistant", "no target"), (2, "assistant", "yes")]
    return out


def test_digests(spark):
    given_turns = conversations()
    rows = [(c, t, r, x) for c, turns in given_turns.items() for t, r, x in turns]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("example", F.lit("x")).withColumn("formatted", F.lit("y"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(chat_format.expand(turns)).collect()}
    assert got == {c: expected(t) for c, t in given_turns.items()}


def test_rows_without_a_conversation_stand_by_themselves(spark):
    rows = [(None, 5, "user", "n"), (None, 6, "assistant", "m"), (None, 6, "assistant", "m"), (1, 0, "assistant", "x")]
    examples = chat_format.expand(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(examples.where("conv_id is null")).collect())
    assert got == sorted((None, *expected([r[1:]])) for r in rows[:3])
    assert chat_format.digest(examples).count() == 4


def test_examples(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "</turn>"), (1, 3, "assistant", "a#b"), (1, 4, "user", "bye")], SCHEMA)
    rows = chat_format.expand(turns).orderBy("example").collect()
    assert [r.formatted[r.loss_start : r.loss_end] for r in rows] == ["yo", "a#b", ""]
    assert rows[0].formatted == "### user\nhi</turn>\n### assistant\nyo</turn>\n"
    assert rows[2].formatted.startswith(rows[1].formatted) and rows[1].formatted.startswith(rows[0].formatted)
    assert rows[1].formatted.count("</turn>\n") == 4


@pytest.fixture(scope="module")
def round_trip(spark):
    def run(texts):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
        back = df.select("k", "t", chat_format.escape(F.col("t")).alias("e")).select("k", "t", "e", chat_format.unescape(F.col("e")).alias("b"))
        return back.collect()

    return run


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("\\EHN#</turn>\n ab")), max_size=30), min_size=1, max_size=20))
def test_escaping_is_reversible(round_trip, texts):
    for r in round_trip(texts):
        assert r.b == r.t and "</turn>" not in r.e and "###" not in r.e


def test_whole_table(spark):
    source = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        source.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    source[PROBE_ID] = [(0, "user", PROBE_TEXT), (1, "assistant", PROBE_TEXT)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op9_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got == {c: expected(t) for c, t in source.items()}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_format.expand(none).count() == 0 and chat_format.digest(chat_format.expand(none)).count() == 0
