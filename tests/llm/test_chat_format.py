import random

from pyspark.sql import functions as F

from tidemark.llm import chat_format as op

PIECES = ["</turn>", "</part>", "### ", "\\", "<", "/turn>", "/part>", "#", "\n", "user: ", "é", " ok", "</turn>\n", "## ", "$1", "<\\/turn>", "#\\## "]


def test_round_trip_merge_and_loss(spark):
    rnd = random.Random(2)
    rows = []
    for conv in range(80):
        for turn in range(rnd.randint(1, 9)):
            text = "".join(rnd.choices(PIECES, k=rnd.randint(0, 8)))
            rows.append((conv, rnd.choice([turn, None]) if conv % 9 == 4 else turn, rnd.choice(["user", "assistant", "assistant", "odd: <role>\n\\b", None]), rnd.choice([text, text, None])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = op.format_chats(df).select("conv_id", "segments", "formatted", op.read_turns(F.col("formatted")).alias("turns"), op.learned_text(F.col("segments")).alias("learned")).collect()
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [t[2:] for t in turns]
        assert r.learned == "".join(t[3] for t in turns if t[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        changes = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:], strict=False))
        assert r.formatted.count("</turn>") == changes and r.formatted.count("</part>") == len(turns) - changes


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (None, 2, "assistant", None), (3, 1, "user", "b"), (3, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((str(r.conv_id), r.formatted) for r in op.format_chats(df).collect())
    assert got == [("3", "### user: b</part>b</turn>\n"), ("None", "### assistant: </turn>\n"), ("None", "### user: a</turn>\n"), ("None", "### user: a</turn>\n")]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.format_chats(df).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    plan = op.format_chats(df).select(op.read_turns(F.col("formatted")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
