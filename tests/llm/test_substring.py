from collections import Counter

import pytest

from tidemark.llm import substring_dedup as op


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (9, 4), (5, 3)])
def test_against_brute_force(spark, odd_docs, window, gram):
    docs = odd_docs
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in op.deduplicated(docs, window=window, gram=gram).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], window)


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in op.deduplicated(docs).collect())
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert got == want
    assert sum(x[2] for x in want) > 0


def test_string_ids_and_rows_without_an_id(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [("a", passage), ("b", "x " + passage + " y"), ("b", "another text of this id"), (None, " ".join(f"n{k}" for k in range(50)))]
    rows += [(None, f"{passage} tail {k}") for k in range(3)] + [(None, "short"), (None, None), ("c", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, th int")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in op.deduplicated(docs).collect())
    assert got == brute(rows, 35)


def test_rows_whose_short_hashes_clash_keep_their_own_spans(spark):
    """Two texts without an id and with equal 32-bit hashes: only one of them is repeated elsewhere."""
    from pyspark.sql import functions as F

    head = " ".join(f"w{k}" for k in range(40))
    many = spark.range(300_000).select(F.col("id"), F.concat(F.lit(head + " "), F.col("id").cast("string")).alias("text"))
    pair = many.groupBy(F.hash("text").alias("h")).agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count("*").alias("n")).where("n > 1").first()
    assert pair is not None
    one, two = pair.a, " ".join(reversed(pair.b.split()))
    rows = [(None, one), (None, pair.b), (None, two), ("k", one)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in op.deduplicated(docs).collect())
    assert got == brute(rows, 35)


def test_empty(no_docs):
    assert op.deduplicated(no_docs).count() == 0
