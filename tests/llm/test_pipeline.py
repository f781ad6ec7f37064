from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontamination, test_line_dedup, test_packing, test_shingle_dedup


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        kept.append((before.cache(), docs.cache()))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(b.columns == columns for b, _ in kept)
    # 1: rejected documents go and no others
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stayed = {r.doc_id for r in kept[0][1].collect()}
    known = [(labels[r.doc_id], r.doc_id in stayed) for r in kept[0][0].collect() if r.doc_id in labels]
    assert all(s for q, s in known if q == 1) and not any(s for q, s in known if q == 0)
    # 2: the texts of all documents, without repeated lines
    rows = [(r.doc_id, r.text) for r in kept[1][0].collect()]
    assert sorted(((str(r.doc_id), r.text) for r in kept[1][1].collect()), key=str) == test_line_dedup.brute(rows, 20)
    # 3: the least document of each component of near copies
    rows = [(r.doc_id, r.text) for r in kept[2][0].collect()]
    assert sorted((r.doc_id for r in kept[2][1].collect()), key=str) == test_shingle_dedup.brute_kept(rows)
    # 4: documents without a benchmark passage
    rows = [(r.doc_id, r.text) for r in kept[3][0].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [test_decontamination.words(t)] for k in range(max(len(w) - 10, 0) + 1)}
    clean = [i for i, t in rows for w in [test_decontamination.words(t)] if not any(tuple(w[k : k + 10]) in windows for k in range(len(w)))]
    assert sorted(r.doc_id for r in kept[3][1].collect()) == sorted(clean)
    # 5: every token of what is left, once
    test_packing.check([(r.doc_id, r.text) for r in kept[4][0].collect()], kept[4][1].collect())


def test_odd_documents_pass_through(spark, odd_docs, sf_dir):
    docs = odd_docs
    for name in ("score", "items", "hit_runs", "near_items", "won_id", "gone", "root", "component_id", "label", "id", "th", "line"):
        docs = docs.withColumn(name, F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, sf_dir).cache()
        if "text" in docs.columns:
            assert docs.columns == columns and {r["items"] for r in docs.collect()} <= {"mine"}
    assert docs.count() > 0


def test_run_over_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
