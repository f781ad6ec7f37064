"""Exact substring removal by counting phrases between content-defined anchors, in place of relative Lempel-Ziv parsing.

Every document is cut into phrases at content-defined anchors: the anchor of a window is the hash-least group of
``GRAM`` words in it, so equal windows have equal anchors and every window is owned by exactly one. The phrase of an
anchor is all windows that it owns, as one stretch of words. Equal phrases are counted over the corpus, and all windows of
a phrase that occurs twice are repeated. Where an anchor has several distinct phrases, the windows of one representative
of each are looked up one by one. A phrase whose anchor occurs once holds no repeated window, since equal windows
share their anchor. So exactly the windows of ``WINDOW`` words are found that start in two places or more, same
document included.

Counts are aggregated before they are shuffled, so a passage in a third of all documents is one row a task, and the
boundary windows are those of one representative of each distinct phrase.

Equality of phrases is decided on two 64-bit hashes, of the anchor and of the words; that of single windows on one that mixes both.

Defined results: a null or empty text has no words and loses none; a text that is repeated as a row is a copy like
any other; rows that share an id or have none are told apart by a 64-bit hash and the length of their text, rows alike in
both are the same text; ids of any type are kept as they are; a very long text is cut whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

WINDOW, GRAM = 35, 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64."""
    have = getattr(_powers, "have", None)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers.have = tuple(out)
    return have[0][:n], have[1][:n]


def _group_hashes(prefix: np.ndarray, inverse: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words first..last-1, from the running sums of word hash times power."""
    return common.mix((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64))


class Parsed:
    """The windows, anchors and phrases of the rows of one chunk, as arrays over word numbers."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
        starts, ends, row = common.word_spans(data, offsets)
        n = len(starts)
        self.row, self.n_words = row, np.bincount(row, minlength=batch.num_rows)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        power, self.inverse = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(common.word_hashes(data, starts, ends) * power[:n], out=self.prefix[1:])
        self.spans = data, starts, ends
        if n < window:
            self.windows = self.owner = np.zeros(0, np.int64)
            return
        at = np.arange(n - gram + 1)
        grams = _group_hashes(self.prefix, self.inverse, at, at + gram)
        inside = row[: n - window + 1] == row[window - 1 :]
        self.windows = np.flatnonzero(inside)
        self.owner = _leftmost_least(grams, window - gram + 1)[: n - window + 1][inside]
        self.grams = grams

    def phrases(self, window: int) -> tuple[np.ndarray, ...]:
        """Anchor hash, phrase hash, row, first window (word number) and number of windows of each phrase."""
        if not len(self.windows):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none, none
        row = self.row[self.windows]
        new = np.flatnonzero(np.concatenate([[True], (self.owner[1:] != self.owner[:-1]) | (row[1:] != row[:-1])]))
        first = self.windows[new]
        count = np.diff(np.concatenate([new, [len(self.windows)]]))
        phrase = _group_hashes(self.prefix, self.inverse, first, first + count - 1 + window)
        return self.grams[self.owner[new]], phrase, row[new], first, count


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of its least, the leftmost of equals."""
    best, where, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        where = np.where(take, where[step:], where[:-step])
        have += step
    return where


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


#: What names a row: its id, and its text's hash and length in characters.
_ROW = ("id", "th", "size")


def _id_type(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def _phrase_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, phrase, id, th, size, first, n): every phrase of the corpus; first and n count in windows of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            parsed = Parsed(batch, window, gram)
            anchor, phrase, row, first, n = parsed.phrases(window)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(phrase), *(batch.column(k).take(at) for k in range(3)), pa.array((first - parsed.first_word[row]).astype(np.int32)), pa.array(n.astype(np.int16))], names=["anchor", "phrase", *_ROW, "first", "n"])

    return docs.mapInArrow(run, f"anchor long, phrase long, id {_id_type(docs)}, th long, size int, first int, n short")


def _boundary_windows(docs_edges: DataFrame, window: int, gram: int) -> DataFrame:
    """(hash, id, th, size, at): the windows of the phrases that ``edges array<int>`` names by their first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            lists = batch.column(4)
            if lists.null_count == len(lists):
                continue
            parsed = Parsed(batch, window, gram)
            anchor, _, row, first, n = parsed.phrases(window)
            wanted = np.concatenate([np.zeros(0, np.int64), *(parsed.first_word[i] + np.asarray(x, np.int64) for i, x in enumerate(lists.to_pylist()) if x)])
            take = np.isin(first, wanted)
            anchor, row, first, n = anchor[take], row[take], first[take], n[take]
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            hashes = _group_hashes(parsed.prefix, parsed.inverse, at, at + window)
            rows = np.repeat(row, n)
            of = pa.array(rows)
            yield pa.RecordBatch.from_arrays([_signed(common.mix(np.repeat(anchor, n)) ^ hashes), *(batch.column(k).take(of) for k in range(3)), pa.array((at - parsed.first_word[rows]).astype(np.int32))], names=["hash", *_ROW, "at"])

    return docs_edges.mapInArrow(run, f"hash long, id {_id_type(docs_edges)}, th long, size int, at int")


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, th, size, text): the last but one tell rows apart that share an id or have none."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), F.coalesce(F.length("text"), F.lit(-1)).alias("size"), "text")


def _same_row(prefix: str) -> Column:
    return F.col("id").eqNullSafe(F.col(f"{prefix}id")) & (F.col("th") == F.col(f"{prefix}th")) & (F.col("size") == F.col(f"{prefix}size"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id``, ``th``, ``size`` and ``spans array<struct<first, n>>``, written: runs of windows (by first word) that also start elsewhere."""
    since = common.mark()
    source = _keyed(docs, id_col)
    phrases = common.written(_phrase_rows(source, window, gram), "phrases")
    counted = common.written(
        phrases.groupBy("anchor", "phrase").agg(F.count("*").alias("c"), F.min(F.struct(*_ROW, "first")).alias("at")), "reference"
    )
    shared = counted.groupBy("anchor").agg(F.count("*").alias("distinct_phrases")).where("distinct_phrases > 1").withColumnRenamed("anchor", "a2")
    factors = counted.where("c > 1").select(F.col("anchor").alias("a2"), F.col("phrase").alias("p2"))
    whole = phrases.join(factors, (F.col("anchor") == F.col("a2")) & (F.col("phrase") == F.col("p2"))).select(*_ROW, "first", F.col("n").cast("int").alias("n"))
    edges = counted.join(shared, F.col("anchor") == F.col("a2")).select(*(F.col(f"at.{c}").alias(f"e{c}") for c in _ROW), F.col("at.first").alias("first"))
    edges = edges.groupBy(*(f"e{c}" for c in _ROW)).agg(F.collect_list("first").alias("edges"))
    looked = common.written(_boundary_windows(source.join(edges, _same_row("e")).select(*_ROW, "text", "edges"), window, gram), "boundary")
    twice = looked.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select(F.col("hash").alias("h2"))
    twice = common.written(twice, "boundary-hits")  # a scan on either side lets Spark split a hot window
    found = looked.join(twice, F.col("hash") == F.col("h2")).select(*_ROW, F.col("at").alias("first"), F.lit(1).alias("n"))
    spans = whole.union(found).groupBy(*_ROW).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return common.written_last(spans, "spans", since)


def _cut(docs_spans: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            n_words, n_removed, kept = [], [], []
            lists = batch.column(4)
            for i, text in enumerate(common.texts_of(batch)):
                words = text.split()
                spans = lists[i]
                n_words.append(len(words))
                if spans.is_valid:
                    flat = spans.values
                    edge = np.zeros(len(words) + window + 1, np.int64)
                    first, n = flat.field("first").to_numpy(), flat.field("n").to_numpy()
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n - 1 + window, -1)
                    gone = np.cumsum(edge)[: len(words)] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return docs_spans.mapInArrow(run, f"id {_id_type(docs_spans)}, n_words long, n_removed long, kept_text string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) of every document."""
    common.small_batches(docs.sparkSession)
    spans = duplicate_spans(docs, id_col, window, gram).withColumnsRenamed({c: f"s{c}" for c in _ROW})
    rows = _keyed(docs, id_col).join(spans, _same_row("s"), "left").select(*_ROW, "text", "spans")
    return _cut(rows, window).withColumnRenamed("id", id_col)
