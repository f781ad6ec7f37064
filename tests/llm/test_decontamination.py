import random
import re

import pytest

from tidemark.llm import decontamination as op
from tidemark.llm.decontamination import n_hit

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window, slack):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, ids, near = set(), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(len(v) - window, 0) + 1 if v else 0):
                win = v[k : k + window]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(item)
                if any(all(x in w[max(0, s + j - slack) : max(0, s + j + slack + 1)] for j, x in enumerate(win)) for s in range(-slack, len(w) + slack)):
                    near.add(item)
        out.append((str(doc_id), len(w), len(hit), sorted(x for x in ids if x is not None), sorted(x for x in near if x is not None)))
    return sorted(out)


def run(docs, bench, **more):
    got = op.annotate(docs, bench, **more).select("doc_id", "n_words", n_hit().alias("n_hit"), "items", "near_items").collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.near_items) for r in got)


@pytest.mark.parametrize(("window", "block_bytes"), [(10, 1 << 20), (4, 1 << 20), (4, 150)])
def test_against_brute_force(spark, window, block_bytes):
    rnd = random.Random(window)
    vocabulary = ["the", "cat", "Sat", "on", "a", "mat", "été", "42", "ok"]
    items = [(str(k), " ".join(rnd.choices(vocabulary, k=n))) for k, n in enumerate([12, 15, 3, 1, 20, 11, 10])] + [(None, "the cat sat"), ("7", None), ("8", ""), ("0", "a mat 42 a mat")]
    items[3] = ("3", "unheard")
    docs = []
    for i in range(60):
        text = rnd.choices(vocabulary, k=rnd.randint(0, 40))
        if i % 3 == 0:
            piece = words(items[i % 7][1])
            text[5:5] = [x.upper() + "," for x in piece]
        if i % 5 == 0 and len(text) > 8:
            text[7], text[8] = text[8], text[7]
        docs.append((i, " ".join(text)))
    docs += [(60, None), (61, ""), (62, "?!"), (None, items[0][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, [1]) for i, t in docs], "doc_id long, text string, items array<int>")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert run(df, bench, window=window, block_bytes=block_bytes) == brute(docs, items, window, 2)


def test_empty(spark, no_docs, odd_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert run(no_docs, bench) == []
    assert all(r[2:] == (0, [], []) for r in run(odd_docs, bench))


def test_long_items_are_searched_by_segment(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 7)
    rnd = random.Random(8)
    items = [("a", " ".join(rnd.choices("abcdefghij", k=100))), ("b", "x y"), (None, "p q r s")]
    docs = [(k, " ".join([*rnd.choices("abcdefghij", k=9), *items[0][1].split()[k * 7 : k * 7 + 16], "x", "y"])) for k in range(14)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert run(df, bench) == brute(docs, items, 10, 2)


def test_a_large_benchmark_costs_the_driver_a_block(spark):
    """Many blocks: what the driver's Python allocates stays near one block's bytes."""
    import tracemalloc

    from pyspark.sql import functions as F

    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id"), k), F.lit(5000))))
    bench = spark.range(600).select(F.col("id").cast("string").alias("item_id"), F.array_join(words, " ").alias("text"))
    docs = bench.where("item_id % 100 = 7").select(F.col("item_id").cast("long").alias("doc_id"), F.substring("text", 1, 700).alias("text"))
    tracemalloc.start()
    got = run(docs, bench, block_bytes=1 << 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r[0], r[3]) for r in got] == sorted((str(k), [str(k)]) for k in range(7, 600, 100)) and peak < 8 << 18
