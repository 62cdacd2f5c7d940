import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat

TURNS = [(c, t, ["user", "assistant"][t % 2], f"question {c} {t}?" if t % 2 == 0 else "a long answer " * 30 + f"\n{c} {t} more\nlines") for c in range(12) for t in range(2 + c % 5)]


@pytest.fixture(scope="module")
def model(spark):
    return chat.fit(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))


def lines_of(spark, text, conv=1):
    rows = [(conv, 0, i, line, False) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "conv_id long, turn long, line long, text string, blank_before boolean")


def test_markers(spark):
    text = ["User: hi", "**Assistant:** yes", "### Response: x", "<|system|> be kind", "Q: why", "A: so", "note: no", "user hi", "[INST] do", "AI > x", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, text string").orderBy("i").select(F.coalesce(chat.marker_of(F.col("text")), F.lit(0)).alias("m"), chat.without_marker(F.col("text")).alias("t")).collect()
    assert [r.m for r in got] == [2, 3, 3, 1, 2, 3, 0, 0, 2, 3, 0]
    assert [r.t for r in got][:4] == ["hi", "yes", "x", "be kind"]


def test_transcript(spark, model):
    text = "System: be kind\nUser: what is it?\nAssistant: this\n- one\n- two\nUser: and why?\nAssistant: because"
    got = sorted(map(tuple, chat.rendered(lines_of(spark, text), model).collect()), key=lambda r: r[1])
    assert [(r[2], r[3]) for r in got] == [("system", 1), ("user", 1), ("assistant", 3), ("user", 1), ("assistant", 1)]
    assert got[2][4] == "<|assistant|>\nthis\n- one\n- two<|end|>"


def plain_viterbi(model, code):
    """A textbook decoder, line by line and state by state."""
    best = [{s: model.first[s] + model.sign[s][code[0] // 12] + model.text[s][code[0] % 12] for s in range(6)}]
    back = []
    for c in code[1:]:
        now, came = {}, {}
        for s in range(6):
            came[s] = max(range(6), key=lambda p: (best[-1][p] + model.move[p][s], -p))
            now[s] = best[-1][came[s]] + model.move[came[s]][s] + model.sign[s][c // 12] + model.text[s][c % 12]
        best.append(now)
        back.append(came)
    state = max(best[-1], key=lambda s: (best[-1][s], -s))
    out = [state]
    for came in reversed(back):
        state = came[state]
        out.append(state)
    return out[::-1], max(best[-1].values())


def score(model, code, states):
    total = model.first[states[0]]
    for i, (c, s) in enumerate(zip(code, states)):
        total += model.sign[s][c // 12] + model.text[s][c % 12] + (model.move[states[i - 1]][s] if i else 0)
    return total


def test_blocks_against_a_plain_decoder(spark, model, monkeypatch):
    """Two conversations of some hundred lines, cut in blocks and spans of several sizes: a way as good as the best of a textbook decoder."""
    rng = np.random.default_rng(0)
    lines = [rng.choice(["User: a?", "Assistant: b", "plain", "longer text " * 40, "why?"]) for _ in range(400)]
    rows = [(7 if i < 300 else 8, i // 20, i % 20, t, bool(i % 3 == 0)) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, line long, text string, blank_before boolean")
    codes = {c: [r.code for r in chat.observed(df.where(f"conv_id = {c}")).orderBy("turn", "line").collect()] for c in (7, 8)}
    for block, span in ((512, 4096), (7, 4)):
        monkeypatch.setattr(chat, "BLOCK", block)
        monkeypatch.setattr(chat, "SPAN", span)
        got = chat.recover(df, model).orderBy("conv_id", "turn", "line").collect()
        for c, code in codes.items():
            states = [r.state for r in got if r.conv_id == c]
            assert score(model, code, states) == pytest.approx(plain_viterbi(model, code)[1], abs=1e-9)


def test_held_out_conversations(spark):
    turns = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"what is {c} {t}?" if t % 2 == 0 else "a long answer " * 30 + f"\n{c} {t} more\nlines") for c in range(60) for t in range(2 + c % 5)], "conv_id long, turn long, role string, text string")
    got = {r.held_out: r for r in chat.accuracy(turns, chat.fit(turns.where(~chat.held_out(F.col("conv_id"))))).collect()}
    assert got[True].n_lines > 20 and got[True].roles > 0.9 and got[True].begins > 0.9


def test_recovers_roles(spark, model):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.role for r in chat.rendered(chat.as_transcripts(turns), model).collect()}
    want = {(c, t): role for c, t, role, _ in TURNS}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)


def test_odd_and_empty(spark, model):
    rows = [(None, 0, 0, "User: a", None, "x"), (1, None, None, None, True, "x"), (1, 0, 0, "", False, "x"), (1, 0, 0, "same place", False, "x"), (2, 5, 0, "y" * 50_000, False, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, line long, text string, blank_before boolean, state string")
    got = chat.recover(df, model).collect()
    assert len(got) == 5
    assert chat.rendered(df.where("false"), model).collect() == []
    chat.fit(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert {r.conv_id for r in chat.rendered(df, model).collect()} == {None, 1, 2}
