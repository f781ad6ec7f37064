import math
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import quality_model as op


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def test_passages_cover_whole_texts():
    x, first = op.encode(batch(["a " * 97, None, "", "b " * 96, "c " * 300]))
    assert first.tolist() == [0, 2, 3, 4, 5] and len(x) == 9
    assert not x[2].any() and not x[3].any() and x[1].any()


def test_encoding_does_not_depend_on_neighbours():
    texts = ["Some words, here!\nAnd £ more " * 30, "", "x" * 900, "one two three one two three"]
    whole, first = op.encode(batch(texts))
    alone = np.concatenate([op.encode(batch([t]))[0] for t in texts])
    assert np.allclose(whole, alone)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    x, first, y = rng.normal(size=(9, op.WIDTH)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    shapes = {"W": (op.WIDTH, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "d": (1,)}
    model = op.Attention(np.zeros(op.WIDTH), np.ones(op.WIDTH), {k: rng.normal(size=s) * 0.3 for k, s in shapes.items()})

    def loss():
        p = model.score(x, first)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model.gradients(x, first, y)
    for name, value in model.held.items():
        at = tuple(rng.integers(s) for s in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.01/" + t + ".parquet") for t in ("documents", "labels"))
    model = op.train(docs, labels)
    rows = op.score(docs, model).withColumn("held_out", op.held_out()).withColumn("predicted", op.predicted()).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (3, 1), (3, 0), (4, 7), (None, 1), (999, 0), (202, 0)], "doc_id long, quality int")
    model = op.train(odd_docs, labels)
    assert op.score(odd_docs, model).count() == odd_docs.count()
    assert op.score(no_docs, model).count() == 0
    none = op.train(odd_docs, labels.where("false"))
    assert {r.score for r in op.score(odd_docs, none).collect()} == {0.5}


def test_score_is_the_attention_weighted_mean_of_passages():
    """An own forward pass, passage by passage in plain Python."""
    rng = np.random.default_rng(3)
    x, first = rng.normal(size=(9, op.WIDTH)), np.array([0, 4, 5])
    shapes = {"W": (op.WIDTH, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "d": (1,)}
    p = {k: rng.normal(size=s) * 0.3 for k, s in shapes.items()}
    model = op.Attention(rng.normal(size=op.WIDTH), np.full(op.WIDTH, 0.7), p)
    want, weights = [], []
    for a, b in ((0, 4), (4, 5), (5, 9)):
        hs, es = [], []
        for row in x[a:b]:
            h = [math.tanh(sum(max(-8, min(8, (v - m) / 0.7)) * p["W"][i][k] for i, (v, m) in enumerate(zip(row, model.mean, strict=True))) + p["b"][k]) for k in range(5)]
            gate = [math.tanh(sum(h[i] * p["V"][i][k] for i in range(5))) / (1 + math.exp(-sum(h[i] * p["U"][i][k] for i in range(5)))) for k in range(3)]
            hs.append(h)
            es.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        weights += [e / sum(es) for e in es]
        z = [sum(e * h[k] for e, h in zip(es, hs, strict=True)) / sum(es) for k in range(5)]
        want.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - p["d"][0])))
    assert np.allclose(model.score(x, first), want) and np.allclose(model.attention(x, first), weights)
    slices, op.SLICE_PASSAGES = op.SLICE_PASSAGES, 2
    try:
        assert np.allclose(model.score(x, first), want)
    finally:
        op.SLICE_PASSAGES = slices


def test_attention_learns_which_passage_matters():
    """Bags of noise in which one passage of the positive ones carries a mark: held-out accuracy, and weight on the mark."""
    rng = np.random.default_rng(4)

    def bags(n):
        made, labels, places = [], np.arange(n) % 2, []
        for y in labels:
            bag = rng.normal(size=(int(rng.integers(3, 9)), op.WIDTH)).astype(np.float16)
            k = int(rng.integers(len(bag)))
            bag[k, :6] += 3 * y
            made.append(bag)
            places.append(k)
        return made, labels.astype(float), places

    model = op.fit(*bags(600)[:2])
    test, y, places = bags(200)
    first = np.cumsum([0, *map(len, test)])[:-1]
    x = np.concatenate(test).astype(np.float64)
    assert np.mean((model.score(x, first) > 0.5) == y) > 0.95
    a = model.attention(x, first)
    on_mark = [a[f + k] * len(b) for f, k, b, label in zip(first, places, test, y, strict=True) if label]
    assert np.mean(on_mark) > 1.5


def test_repeated_ids_and_long_texts_are_learned_once(spark):
    docs = spark.createDataFrame([("a", "good words " * 40000), ("b", "bad"), ("b", "bad!"), ("c", "x"), (None, "y")], "doc_id string, text string")
    labels = spark.createDataFrame([(k, q) for k, q in (("a", 1), ("b", 0), ("c", 1))], "doc_id string, quality int")
    held = {r.doc_id for r in docs.where(op.held_out()).collect()}
    model = op.train(docs, labels)
    assert (model is None) == (not {"a", "b", "c"} - held)
    scored = op.score(docs, model).collect()
    assert sorted((str(r.doc_id) for r in scored)) == ["None", "a", "b", "b", "c"]
    assert len(op._thinned(np.zeros((5000, 2)))) == op.FIT_PASSAGES
