import random

import pytest

from tidemark.llm import quality_rules as op


def brute(text):
    text = text or ""
    words = text.encode().split()
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    stats = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return *stats, failed, not failed and not any(r.rejects(text.encode(), op.Counts(*stats[:4], len(lines))) for r in op.RULES)


def judged(docs, **more):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return sorted((str(r.doc_id), *(r[n] for n in names)) for r in op.judge(docs, **more).collect())


def test_against_brute_force(odd_docs):
    assert judged(odd_docs) == sorted((str(r.doc_id), *brute(r.text)) for r in odd_docs.collect())


def test_real_documents_and_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = judged(docs)
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    quality = {str(r.doc_id): r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judgements = [(quality[g[0]], g[-2], g[-1]) for g in got if g[0] in quality]
    assert not any(kept for q, _, kept in judgements if q == 0)
    assert all(kept for q, failed, kept in judgements if q == 1 and not failed)


def test_order_changes_the_work_but_not_the_verdict(odd_docs):
    rules = list(op.RULES)
    random.Random(1).shuffle(rules)
    assert judged(odd_docs, rules=tuple(rules)) == judged(odd_docs)


def test_cascade_runs_best_rejection_per_cost_first_given_those_before():
    rules = tuple(op.Rule(x, None) for x in ("slow", "never", "cheap", "twin"))
    # twin rejects what cheap does and a little more, so after cheap it is worth less than slow
    found = op.ordered(rules, [4.0, 1.0, 1.0, 1.5], {0b1100: 50, 0b1000: 1, 0b0001: 20, 0: 29})
    assert [e.rule.name for e in found] == ["cheap", "slow", "twin", "never"]
    assert [round(e.rejected, 3) for e in found] == [0.5, 0.4, round(1 / 30, 3), 0.0]


def test_measured_on_documents_that_pass_the_base(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = spark.createDataFrame([(1, good), (2, good + " !" * 20), (3, "! ! !")], "doc_id long, text string")
    shares = {e.rule.name: e.rejected for e in op.plan_cascade(docs)}
    assert shares["exclaiming"] == 0.5 and sum(shares.values()) == 0.5


def test_a_document_leaves_at_its_first_rejection(spark):
    rules = (op.Rule("certain", lambda t, n: True), op.Rule("never", lambda t, n: False))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    found = op.judge(docs, rules=rules).first()
    assert found.failed_rule == "certain" and not found.kept and not found.base_failed


def test_empty(no_docs):
    assert op.judge(no_docs).count() == 0


@pytest.mark.parametrize("text", ["", "\n\n", "a"])
def test_short_texts_fail_the_base(spark, text):
    r = op.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.base_failed and not r.kept and r.failed_rule == "base"
