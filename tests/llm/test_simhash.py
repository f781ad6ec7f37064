import random

import numpy as np
from xxhash import xxh64_intdigest

from tidemark.llm import simhash_dedup as op
from tidemark.llm.components import components


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def brute_roots(values):
    """Value -> least value reachable over links of two bits or fewer."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                a2, b2 = sorted((top(a), top(b)))
                parent[b2] = a2
    return {v: top(v) for v in values}


def test_against_brute_force(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = op.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    fps = [(r.doc_id, brute_fp(r.text)) for r in rows]
    roots = brute_roots([f for _, f in fps])
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in got) == sorted((str(i), f, least.get(roots[f])) for i, f in fps)


def test_masks_cover_all_pairs_within_radius():
    ms = op.masks(list(range(64)))
    assert len(ms) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not ((m >> a) & 1 or (m >> b) & 1) for m in ms)


def test_large_buckets_lose_no_link(spark):
    rnd = random.Random(3)
    values = set()
    for _ in range(6):
        at = rnd.getrandbits(64)
        for _ in range(150):
            values.add(at)
            for _ in range(rnd.choice([1, 1, 2, 2, 3, 5])):
                at ^= 1 << rnd.randrange(64)
    values = [v - 2**64 if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_roots(values)
    for bucket in (64, 4):
        got = {r.node: r.root for r in components(op.covering_links(distinct, bucket=bucket)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_deduplicated_keeps_one_of_each_component(spark, odd_docs):
    kept = op.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text for r in kept.collect()]
    roots = brute_roots([brute_fp(r.text) for r in odd_docs.collect()])
    assert sorted(roots[brute_fp(t)] for t in texts) == sorted(set(roots.values()))


def test_empty(no_docs):
    assert op.near_duplicates(no_docs).count() == 0
    assert op.deduplicated(no_docs).count() == 0


def test_forest_is_spanning():
    fps = np.array([0, 1, 3, 7, 255, 254], np.int64)
    assert len(op._forest(fps, 2)) == 4
