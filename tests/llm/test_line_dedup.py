import random

import pytest

from tidemark.llm import line_dedup as op


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows, min_chars, edits=1):
    """Expected texts by (id, text) in order of place; ids are unique or rows alike."""
    places = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    before, out = [], {}
    for i, t in places:
        kept, here = [], []
        for line in t.split("\n"):
            dup = any(line == x or edits and min(len(line), len(x)) >= min_chars and distance_one(line, x) for x in before + here)
            if not dup or not line.strip(" \t\r\x0b\x0c"):
                kept.append(line)
            here.append(line)
        before += here
        out[i, t] = "\n".join(kept)
    return sorted([(str(i), None if t is None else out[i, t]) for i, t in rows], key=str)


@pytest.mark.parametrize("min_chars", [20, 4])
def test_against_brute_force(spark, min_chars):
    rnd = random.Random(min_chars)
    base = ["".join(rnd.choices("ab é\U0001f600", k=rnd.randint(3, 30))) for _ in range(25)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab"]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            x = rnd.choice(base)
            for _ in range(rnd.randint(0, 2)):
                k = rnd.randrange(len(x) + 1)
                x = rnd.choice([x, x[:k] + x[k + 1 :], x[:k] + "a" + x[k:], x[:k] + "b" + x[k + 1 :]])
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (5, rows[5][1]), (None, rows[7][1]), (103, "x" * 5000 + "\n" + "x" * 5001 + "\n" + "y" * 6000)]
    df = spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, len int, gone string")
    got = op.deduplicated(df).drop("gone__") if min_chars == 20 else op.deduplicated(df, near_chars=min_chars).drop("gone__")
    assert got.columns == df.columns
    assert sorted([(str(r.doc_id), r.text) for r in got.collect()], key=str) == brute(rows, min_chars)


def test_equal_lines_alone(spark):
    rows = [(k, "\n".join(["ab", "", " \t", "a line of text that is long", f"a line of text that is lon{k}", "ab"][k % 3 :])) for k in range(6)]
    df = spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")
    assert sorted([(r.doc_id, r.text) for r in op.deduplicated(df, edits=0).collect()]) == brute(rows, 20, 0)
    with pytest.raises(ValueError):
        op.deduplicated(df, edits=2)


def test_empty(no_docs):
    assert op.deduplicated(no_docs).count() == 0


def test_no_python_in_the_plan(spark, odd_docs):
    plan = op.deduplicated(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
