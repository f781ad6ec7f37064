"""A single text of 20 MB costs each worker a bounded multiple of itself and gives whole results."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, quality_model, quality_rules, substring_dedup

SIZE = 20 << 20


@pytest.fixture(scope="module")
def long_batch():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 10))) for _ in range(5000)]
    line = " ".join(rnd.choices(words, k=200_000))
    text = "\n".join([line] * (SIZE // len(line) + 1))[:SIZE]
    return text, pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])


def peak_of(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / SIZE
    finally:
        tracemalloc.stop()


def test_quality_rules(long_batch):
    text, batch = long_batch
    stats, peak = peak_of(lambda: quality_rules.base_stats(batch, common.texts_of(batch)))
    assert stats["n_words"][0] == len(text.split()) and peak < 24


def test_quality_model(long_batch):
    text, batch = long_batch
    (x, first), peak = peak_of(lambda: quality_model.encode(batch))
    assert len(x) == -(-len(text.split()) // quality_model.PASSAGE) and first.tolist() == [0] and peak < 16


def test_hashes_do_not_depend_on_slices(long_batch):
    text, _ = long_batch
    data, offsets = common.text_buffer(pa.array([text[:300_000] + " " + "y" * 700_000 + " z"]))
    starts, ends, _ = common.word_spans(data, offsets)
    assert np.array_equal(common.word_hashes(data, starts, ends), np.concatenate([common.word_hashes(data, starts[k : k + 1], ends[k : k + 1]) for k in range(len(starts))]))


def test_substrings(long_batch):
    _, batch = long_batch
    _, peak = peak_of(lambda: substring_dedup.Parsed(batch, 35, 8).phrases(35))
    assert peak < 16
