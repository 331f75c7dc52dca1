"""op12: odd rows, long conversations and control strings, against a plain Python formatter and parser."""

import random

from pyspark.sql import functions as F

from ledgerlens.llm.chat_format import END, NEXT, SAY, START, conversations, escape, format_conversations, unescape

MARKS = [START, SAY, NEXT, END, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "<\\|end|>", "a", "\n", "é", " "]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 8) for r in rows],
                                 "conv_id long, turn long, role string, text string, formatted string, piece int, loss int")


def _check(spark, rows, **kw):
    got = {r.conv_id: r for r in conversations(format_conversations(_frame(spark, rows), **kw)).collect()}
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].learned == "".join(t for r, t in turns if r == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert got[c].formatted.count(START) == got[c].formatted.count(END) == blocks  # escaped texts hold no mark
        assert got[c].formatted.count(NEXT) == len(turns) - blocks
    return got


def test_turns_come_back(spark):
    dice = random.Random(3)
    rows = [(c, t, dice.choice(["user", "assistant", "system", None, "<|say|>"]),
             dice.choice([None, "", "".join(dice.choices(MARKS, k=dice.randrange(12)))]))
            for c in range(40) for t in range(dice.randrange(1, 12))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (50, None, "user", "first"), (50, 0, "user", "then"),
             (51, 4, "user", "same"), (51, 4, "user", "same"), (51, 4, "assistant", "same"), (52, -700, "user", "long " * 200_000)]
    _check(spark, rows)


def test_long_conversations_are_cut_and_joined(spark):
    rows = [(1, t, "assistant" if t % 50 > 5 else "user", f"t{t}") for t in range(1000)]
    rows += [(2, t, "user", "again") for t in range(600)]  # one block over all pieces
    pieces = format_conversations(_frame(spark, rows), piece_turns=64)
    assert pieces.groupBy("conv_id").count().where("conv_id = 1").first()["count"] == 16
    got = _check(spark, rows, piece_turns=64)
    whole = {r.conv_id: r.formatted for r in conversations(format_conversations(_frame(spark, rows), piece_turns=2000)).collect()}
    assert {c: r.formatted for c, r in got.items()} == whole  # pieces do not show


def test_escapes_are_reversible(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choices(MARKS, k=dice.randrange(8))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escape(F.col("t")))
    for r in df.withColumn("u", unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(m in r.e for m in MARKS[:10])


def test_no_rows(spark):
    assert conversations(format_conversations(_frame(spark, []))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = conversations(format_conversations(_frame(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
