"""Python workers, which stay for later stages beside the JVM's heap, keep little of what a stage took."""

import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination

PATH = public_tokenizers.path("word_bpe_49k.json")

HELD = """
import re
import numpy as np
import pyarrow as pa
import pyarrow.compute
from tokenizers import Tokenizer
from tidemark.llm import common, packing

def anonymous():
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["some words"])], names=["id", "text"])
before = anonymous()
"""


def held_after(code: str) -> float:
    """MB that a process holds more after the code than before it."""
    run = subprocess.run([sys.executable, "-c", HELD + code + "\nprint(anonymous() - before)"], capture_output=True, text=True, check=True)
    return float(run.stdout)


def test_a_tokenizer_costs_what_is_kept_of_its_file():
    assert held_after(f"words = packing.WordTokenizer({PATH!r})") < 32


def test_a_task_gives_back_what_it_freed():
    code = """
def run(batches):
    for b in batches:
        freed = [bytes(2000) for _ in range(50_000)]
        yield b, bytes(2000)  # lies above what is freed

rows = list({}(run)([batch]))
"""
    assert held_after(code.format("")) > 64 and held_after(code.format("common.tidy")) < 16


def test_every_worker_function_of_the_pipeline_gives_memory_back(spark, sf_dir, monkeypatch):
    seen, plain = [], DataFrame.mapInArrow
    for kind in {DataFrame, type(spark.range(0))}:
        monkeypatch.setattr(kind, "mapInArrow", lambda self, func, *a, f=plain if kind is DataFrame else kind.mapInArrow, **b: seen.append(func) or f(self, func, *a, **b))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") < 60)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert len(seen) >= 10 and {f.__code__.co_name for f in seen} == {"tidied"}


def test_the_table_of_hits_starts_no_python_workers(spark, monkeypatch):
    made = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"), spark.createDataFrame([("a", "one two three four")], "item_id string, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("rows that Python pickles"))
    assert [r["items"] for r in decontamination.annotate(*made).collect()] == [["a"]]
    assert decontamination._no_hits(spark).schema.simpleString() == "struct<" + ",".join(c.replace(" ", ":") for c in decontamination.HITS.split(", ")).replace("long", "bigint") + ">"
