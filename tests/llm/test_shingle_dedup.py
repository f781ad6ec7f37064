import random
import time

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import shingle_dedup, simhash_dedup


def grams(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_kept(rows):
    """Least ids of the components of pairs with similarity 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((i is None, i), least.get(find(k), (i is None, i)), key=lambda x: (x[0], x[1] or 0))
    return sorted((i for _, i in least.values()), key=str)


@pytest.fixture(scope="module")
def near_rows():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    common = rnd.choices(vocabulary, k=40)
    rows = []
    for _ in range(25):
        base = rnd.choices(vocabulary, k=rnd.randint(4, 150))
        if rnd.random() < 0.5:
            base = base + common
        for _ in range(rnd.randint(1, 6)):
            words = list(base)
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
            if rnd.random() < 0.4:
                base = words  # chains
    return rows


def test_stage_finds_all_near_copies(spark, near_rows, odd_docs):
    odd = [(1000 + (r.doc_id or 0) if r.doc_id is not None else None, r.text) for r in odd_docs.collect()]
    rows = near_rows + odd
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    want = brute_kept(rows)
    assert sorted((r.doc_id for r in got.collect()), key=str) == want
    assert len(brute_kept(near_rows)) < len({frozenset(grams(t)) for _, t in near_rows})


def test_other_bounds_and_string_ids(spark, near_rows):
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in near_rows], "doc_id string, text string")
    for percent in (50, 100):
        sets = [grams(t) for _, t in near_rows]
        top = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    top = [top[b] if x == top[a] else x for x in top]
        want = sorted({min(f"d{k:03}" for k in range(len(top)) if top[k] == r) for r in set(top)})
        assert sorted(r.doc_id for r in simhash_dedup.deduplicated(docs, shingle=5, percent=percent).collect()) == want


def test_empty(no_docs):
    assert simhash_dedup.deduplicated(no_docs, shingle=5, percent=80).count() == 0


def test_common_passages_cost_no_disk(spark, monkeypatch):
    """What the sample of a large table misses makes few pairs, unlike sets are told apart before texts are read, shuffle files go."""
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(25)]
    rows = [(i, " ".join([f"w{rnd.randrange(10**6)}" for _ in range(60)] + passage)) for i in range(300)]
    rows += [(1000, rows[7][1] + " end"), (1001, None)]
    pairs, sets = [], []
    agreeing, whole = shingle_dedup._agreeing, shingle_dedup._whole

    def counted(found, *rest):
        pairs.append(found.distinct().count())
        return agreeing(found, *rest)

    def made(texts, key, shingle):
        sets.append(texts.count() if key == "set" else 0)
        return whole(texts, key, shingle)

    monkeypatch.setattr(shingle_dedup, "SAMPLE", 1)
    monkeypatch.setattr(shingle_dedup, "_agreeing", counted)
    monkeypatch.setattr(shingle_dedup, "_whole", made)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    written, write = [], shingle_dedup.common.written_last

    def shuffles():
        return {name for f in files.getAllFiles().mkString("\n").split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}

    before = shuffles()

    def looked(*args):
        until = time.time() + 20
        while (left := len(shuffles() - before - known)) > 0 and time.time() < until:
            time.sleep(0.2)
        written.append(left)
        return write(*args)

    known = set()  # files of this test's own counts
    monkeypatch.setattr(shingle_dedup.common, "written_last", looked)
    got = shingle_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    roots = {r.id: r.root for r in got.collect()}
    assert len(set(roots.values())) == 301 and roots[7] == roots[1000]
    assert sum(pairs) <= 300 and sum(sets) <= 10
    assert written == [0]


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(3)
    a = np.unique(rnd.integers(0, 2**64, 300, np.uint64))
    for size, kept in ((0, 0), (10, 3), (300, 300), (300, 290), (310, 280), (900, 200), (64, 0)):
        b = np.union1d(a[:kept], rnd.integers(0, 2**64, size - kept, np.uint64)) if size else a[:0]
        n = np.array([len(a), len(b)])
        one, two = shingle_dedup._sketches(np.repeat([0, 1], n), np.concatenate([a, b]), n).to_pylist()
        assert len(one) == 64 and 8 * len(two) >= max(64, len(b))
        differing = shingle_dedup._differing(one, two)
        assert differing == shingle_dedup._differing(two, one) <= len(np.setxor1d(a, b))
        assert kept or not size or differing > 16


def test_simhash_nominates_first(spark, monkeypatch):
    """The operator's fingerprints of five words go through its covering tables, and its links are the first that are compared."""
    words = [f"v{i}" for i in range(600)]
    near = next(t for k in range(590) if 0 < (simhash_dedup.fingerprint(t := " ".join(words[:k] + ["other"] + words[k + 1 :]).encode(), 5) ^ simhash_dedup.fingerprint(" ".join(words).encode(), 5)).bit_count() <= 2)
    rows = [(1, " ".join(words)), (2, near.decode()), (3, " ".join(words[:490])), (4, "something else here"), (5, None), (None, "VERY short")]
    seen, rounds = [], []
    covering, linked = simhash_dedup.covering_links, shingle_dedup._linked
    monkeypatch.setattr(simhash_dedup, "covering_links", lambda distinct, *rest: seen.extend(r.fp for r in distinct.collect()) or covering(distinct, *rest))

    def recorded(*args):
        found = linked(*args)
        rounds.append({frozenset((r.a, r.b)) for r in found.collect()})
        return found

    monkeypatch.setattr(shingle_dedup, "_linked", recorded)
    got = shingle_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(f & (2**64 - 1) for f in seen) == sorted(simhash_dedup.fingerprint((t or "").encode(), 5) for _, t in rows)
    _, path = shingle_dedup.common.write_scratch(got, "roots")
    root = {r.id: r.root for r in spark.read.parquet(path).collect()}
    assert root[1] == root[2] == root[3] and len(set(root.values())) == 4
    assert len(rounds[0]) == 1 and any(rounds[1:])
