import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(docs, pieces, length=4096):
    want = defaultdict(list)
    for (i, text), ids in zip(docs, expected([t for _, t in docs]), strict=True):
        want[i].append(ids)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        if len(want[i]) == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(want[i][0]))
                assert p.ids_crc32 == zlib.crc32(np.array(want[i][0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(want[i][0])
        else:
            assert sum(p.length for p in ps) == sum(map(len, want[i]))
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length and at & (at - 1) == 0


def test_odd_documents(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(rows, op.pack(odd_docs, PATH).collect())


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], op.pack(docs, PATH).collect())


def test_words_encode_as_whole_texts():
    texts = ["It's 'twas odd été ẛ̣ ΑΣ ΣΑΣ", "<|endoftext|> a<|startoftext|>b <|endoftext", "x y​z\x85w\x1cq", "́ lone", "don't WE'LL 123 #$%!", "", "  ", "中文 日本語 \U0001f600\U0001f600", "İstanbul ŐŰ ﬁn"]
    words = op.WordTokenizer(PATH)
    for _ in range(2):
        got = [np.frombuffer(x, "<u2").tolist() for x in words.encode([t.encode() for t in texts])]
        assert [[*x, 2] for x in got] == expected(texts)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_each_cell_once_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = op.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_empty(no_docs):
    assert op.pack(no_docs, PATH).count() == 0


def test_another_tokenizer_encodes_whole_texts_and_ids_keep_their_type(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert op.works_by_word(PATH) and not op.works_by_word(path)
    texts = [("a", "Two  words,\n 12 done"), ("b", ""), (None, "été " * 3000)]
    got = op.pack(spark.createDataFrame(texts, "doc_id string, text string"), path).collect()
    t = Tokenizer.from_file(path)
    for i, text in texts:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        pieces = sorted((p for p in got if p.doc_id == i), key=lambda p: p.start)
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces]
        assert sum(p.length for p in pieces) == len(ids)
