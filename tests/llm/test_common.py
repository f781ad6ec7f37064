import random

import pyarrow as pa
import pytest

from tidemark.llm import common


@pytest.mark.parametrize("limit", [1, 10, 50, 10_000])
def test_chunks_hold_all_rows_in_order_within_the_limit(limit):
    rnd = random.Random(limit)
    texts = [rnd.choice(["", None, "x" * rnd.randint(1, 30), "é" * 40]) for _ in range(300)]
    rows, at = [], 0
    while at < len(texts):
        n = rnd.randint(0, 20)
        rows.append(pa.RecordBatch.from_arrays([pa.array(range(at, min(at + n, 300)), pa.int64()), pa.array(texts[at : at + n], pa.string())], names=["id", "text"]))
        at += n
    out = list(common.chunks(iter(rows), "text", limit))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(300))
    for b in out:
        assert b.num_rows == 1 or sum(map(len, common.texts_of(b))) <= limit


def test_words_and_hashes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b\tab", None, "", " \n", "ab" + "x" * 600, "ab" + "x" * 601, "ab"], pa.string())], names=["text"])
    data, offsets = common.text_buffer(batch.column(0))
    starts, ends, row = common.word_spans(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["a", "b", "ab", "ab" + "x" * 600, "ab" + "x" * 601, "ab"]
    assert row.tolist() == [0, 0, 0, 4, 5, 6]
    h = common.word_hashes(data, starts, ends)
    assert h[2] == h[5] and len(set(h.tolist())) == 5
