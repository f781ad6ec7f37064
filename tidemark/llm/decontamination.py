"""Benchmark decontamination with a stored positional inverted index that is distributed by document.

The index is written once: every row is a shard, the documents of about ``SHARD_BYTES`` of text, with the postings of their
terms: the terms' 64-bit hashes in order, how often each occurs, and their positions. Terms that no benchmark item has are
never looked up and leave by a bit map of ``FILTER_BITS`` bits, which may let others pass too. A search reads only this table.

A window of benchmark words is searched in a shard from its rarest term there, since the shard's lists are what is intersected:
that term's positions, moved back by the term's offset, are the candidate starts; they are intersected with the
offset-adjusted lists of the other terms, next rarest first, until none is left or all terms agree. The starts that remain are
exact phrase matches. A proximity match lets every term lie up to ``slack`` words from its place. Candidates are made
``CANDIDATES`` at a time.

The benchmark is a stated query set of any size. Its items become rows of term hashes, long ones in segments that overlap by
all but one word of a window, and are dealt to blocks of about ``block_bytes``. Each block is one job: it goes out to all shards,
its hits are appended to a table, and it is given up before the next, so the driver and a worker hold one block at a time.

Terms are compared by their 64-bit hashes, so a window matches by as many of them as it has words.

Defined results: a null or empty text has no words and no hits; a null or empty item has no windows; an item whose
id is null is searched and its words count as hit, but no id is listed; repeated items count once by id; repeated
documents are judged alike; a very long document is a shard of its own, searched whole; empty tables give empty results or no
hits; further columns are ignored unless in ``keep``, where a column named like a made one gives way (``prefix`` renames those).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tidemark.llm import common

WINDOW, SLACK = 10, 2

#: Bytes of term hashes in a block of the benchmark, and of text in a shard.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 1 << 20

#: Candidate starts, and windows, that a search holds at one time.
CANDIDATES, WINDOWS = 1 << 18, 1 << 16

#: Bits of the map of benchmark terms.
FILTER_BITS = 1 << 23

#: Words of a benchmark segment.
SEGMENT = 1 << 15

_TERM = np.int64(32)


def _fold_table() -> np.ndarray:
    out = np.full(256, 0x20, np.uint8)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return out


_FOLD = _fold_table()


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of letters, digits and characters beyond ASCII, A-Z lower-cased, and the row of each."""
    data, offsets = common.text_buffer(column)
    data = _FOLD[data]
    starts, ends, row = common.word_spans(data, offsets)
    return common.word_hashes(data, starts, ends).view(np.int64), row


# ---------------------------------------------------------------- the stored index


def _gap(window: int, slack: int) -> int:
    """Positions between documents, so that no match reaches over a document's end."""
    return 2 * window + 4 * slack + 2


def term_filter(segments: DataFrame) -> np.ndarray:
    """The bit map of the terms of segments: ``FILTER_BITS`` bits, whatever the benchmark's size."""
    mask = FILTER_BITS - 1

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for tokens in batch.column(0):
                seen[np.frombuffer(tokens.as_buffer(), "<i8") & mask] = True
        words = np.packbits(seen, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at], pa.int64())], names=["at", "bits"])

    found = segments.select("tokens").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # bounded by the map
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return words


def _has_bit(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (FILTER_BITS - 1)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def build_index(docs: DataFrame, keep: tuple[str, ...], wanted: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(shard, docs, terms, counts, positions), written: ``docs`` are the rows' ``keep`` columns with their first position and
    number of words, the rest are little-endian arrays, of the terms that the bit map ``wanted`` has."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(wanted)
    gap = _gap(window, slack)
    fields = [*(docs.schema[c] for c in keep), StructField("first__", IntegerType()), StructField("n_words__", LongType())]
    source = "text" if "text" in keep else "text__"
    rows = docs.select(*keep, *([] if source == "text" else [F.col("text").alias(source)]))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(common.chunks(batches, source, SHARD_BYTES)):
            terms, row = terms_of(batch.column(batch.schema.get_field_index(source)))
            n_words = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(n_words) - n_words + (np.arange(batch.num_rows) + 1) * gap
            at = np.flatnonzero(_has_bit(sent.value, terms))
            at = at[np.argsort(terms[at], kind="stable")]
            distinct, counts = np.unique(terms[at], return_counts=True)
            places = at + (row[at] + 1) * gap
            kept = [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(first, pa.int32()), pa.array(n_words, pa.int64())]
            docs_of = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.StructArray.from_arrays(kept, names=[*keep, "first__", "n_words__"]))
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (distinct.astype("<i8"), counts.astype("<i4"), places.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([task | number], pa.int64()), docs_of, *blobs], names=["shard", "docs", "terms", "counts", "positions"])

    blob = [StructField(c, BinaryType()) for c in ("terms", "counts", "positions")]
    return common.written(rows.mapInArrow(run, StructType([StructField("shard", LongType()), StructField("docs", ArrayType(StructType(fields))), *blob])), "postings")


class Shard:
    """The postings of one row of the index, as one sorted array of term number and position."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes):
        self.terms, self.count = np.frombuffer(terms, "<i8"), np.frombuffer(counts, "<i4").astype(np.int64)
        self.postings = (np.repeat(np.arange(len(self.terms)), self.count) << _TERM) | np.frombuffer(positions, "<i4")

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term here, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def _has(self, terms: np.ndarray, low: np.ndarray, reach: int) -> np.ndarray:
        """Whether each term has a posting in low .. low + reach."""
        key = (terms << _TERM) + low
        found = self.postings[np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)]
        return (found >= key) & (found <= key + reach)

    def search(self, terms: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Exact matches and proximity matches of windows (rows of term numbers, all here), each as (window, start)."""
        order = np.argsort(self.count[terms], axis=1, kind="stable")
        rarest = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
        n = self.count[rarest]
        begin = np.searchsorted(self.postings, rarest << _TERM)
        for a, b in common.slices(n, CANDIDATES):
            window = np.repeat(np.arange(a, b), n[a:b])
            at = np.repeat(begin[a:b] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(int(n[a:b].sum()))
            start = (self.postings[at] & ((1 << 32) - 1)) - order[window, 0]
            near = self._near(terms, order, window, start, slack)
            for r in range(1, terms.shape[1]):
                off = order[window, r]
                ok = self._has(terms[window, off], start + off, 0)
                window, start = window[ok], start[ok]
                if not len(window):
                    break
            yield window, start, *near

    def _near(self, terms: np.ndarray, order: np.ndarray, window: np.ndarray, start: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        if not slack or terms.shape[1] == 1:
            return window, start
        off = order[window, 1]
        ok = self._has(terms[window, off], start + off - 2 * slack, 4 * slack)
        window = np.repeat(window[ok], 2 * slack + 1)
        start = (start[ok][:, None] + np.arange(-slack, slack + 1)).ravel()
        for r in range(terms.shape[1]):
            off = order[window, r]
            ok = self._has(terms[window, off], start + off - slack, 2 * slack)
            window, start = window[ok], start[ok]
        return window, start


# ---------------------------------------------------------------- the benchmark in blocks


def _segments(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, tokens): the distinct segments of all items; every window of an item lies in one of its segments."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            terms, row = terms_of(batch.column(1))
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            of, made = [], []
            for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                for at in range(a, max(b - window + 1, min(a + 1, b)), SEGMENT):
                    of.append(i)
                    made.append(terms[at : min(at + SEGMENT + window - 1, b)].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(made, pa.binary())], names=["item", "tokens"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "item string, tokens binary").distinct()


class Block:
    """Segments one after the other: their terms, and the windows by length as starts and items."""

    def __init__(self, segments: list[tuple[str | None, bytes]], window: int):
        parts = [np.frombuffer(t, "<i8") for _, t in segments]
        self.terms = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.ids = [i for i, _ in segments]
        sizes = np.array([len(x) for x in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        self.groups: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in sorted({*np.minimum(sizes, window).tolist()}):
            mine = np.flatnonzero(np.minimum(sizes, window) == length)
            n = sizes[mine] - length + 1
            starts = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            self.groups.append((length, starts, np.repeat(mine, n)))

    def hits(self, shard: Shard, slack: int) -> tuple[list[tuple[int, np.ndarray]], list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """(length, starts) of exact matches, and (start, segment) of exact and of proximity matches."""
        numbers = shard.numbers(self.terms)
        runs, exact, near = [], [], []
        for length, starts, segment in self.groups:
            for a in range(0, len(starts), WINDOWS):
                terms = numbers[starts[a : a + WINDOWS, None] + np.arange(length)]
                live = np.flatnonzero(terms.min(axis=1) >= 0)
                of = segment[a + live]
                for w, s, nw, ns in shard.search(terms[live], slack) if len(live) else ():
                    runs.append((length, s))
                    exact.append((s, of[w]))
                    near.append((ns, of[nw]))
        return runs, exact, near


HITS = "shard long, doc int, runs array<int>, items array<string>, near_items array<string>"


def _no_hits(spark: SparkSession) -> DataFrame:
    """An empty table of HITS, made in the JVM: one from a Python list starts Python workers of its own on every executor."""
    return spark.range(0).selectExpr(*(f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in HITS.split(", "))))


def _found(block: Block, shard: Shard, first: np.ndarray, n_words: np.ndarray, slack: int) -> list[tuple[int, list[int], list[str], list[str]]]:
    """What the documents with a match have: document, runs of hit words (first, end, ...), items and nearly matching items."""
    runs, exact, near = block.hits(shard, slack)

    def listed(matches: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, set[str]]:
        out: dict[int, set[str]] = {}
        for start, segment in matches:
            doc = np.searchsorted(first, start + slack, "right") - 1
            for d, s in np.unique(np.stack([doc, segment]), axis=1).T.tolist():
                out.setdefault(d, set()).add(block.ids[s])
        return out

    items, close = listed(exact), listed(near)
    if not items and not close:
        return []
    edge = np.zeros(int(first[-1] + n_words[-1]) + 2, np.int32)
    for length, start in runs:
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
    hit = np.cumsum(edge) > 0  # gaps between documents are never hit
    turns = np.flatnonzero(np.diff(hit.astype(np.int8))) + 1
    out = []
    for d in sorted({*items, *close}):
        a, b = np.searchsorted(turns, [first[d], first[d] + n_words[d] + 1])
        out.append((d, (turns[a:b] - first[d]).tolist(), sorted(items.get(d, set()) - {None}), sorted(close.get(d, set()) - {None})))
    return out


def _search(index: DataFrame, segments: list[tuple[str | None, bytes]], window: int, slack: int, path: str) -> None:
    """Append the block's hits to the table at ``path``."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(segments)  # at most about a block's bytes

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(sent.value, window)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                places = batch.column(1)[k].values
                if not places:
                    continue
                first, n_words = (places.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                found = _found(block, Shard(*(batch.column(c)[k].as_py() for c in (2, 3, 4))), first, n_words, slack)
                rows += [(batch.column(0)[k].as_py(), *x) for x in found]
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["shard", "doc", "runs", "items", "near_items"])

    places = F.transform("docs", lambda d: F.struct(d["first__"].alias("first"), d["n_words__"].alias("n"))).alias("places")
    index.select("shard", places, "terms", "counts", "positions").mapInArrow(run, HITS).write.mode("append").parquet(path)
    sent.destroy()


def _merged(hits: DataFrame) -> DataFrame:
    """One row a document, whatever blocks its hits are from."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for lists in batch.column(2).to_pylist():
                out: list[int] = []
                for a, b in sorted((x[k], x[k + 1]) for x in lists for k in range(0, len(x), 2)):
                    if out and a <= out[-1]:
                        out[-1] = max(out[-1], b)
                    else:
                        out += (a, b)
                merged.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(merged, pa.list_(pa.int32())), *batch.columns[3:]], names=["h_shard", "h_doc", "hit_runs__", "items__", "near_items__"])

    def every(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

    rows = hits.groupBy("shard", "doc").agg(F.collect_list("runs").alias("runs"), every("items").alias("items"), every("near_items").alias("near_items"))
    return rows.mapInArrow(run, "h_shard long, h_doc int, hit_runs__ array<int>, items__ array<string>, near_items__ array<string>")


def annotate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, slack: int = SLACK, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """``keep`` and, their names after ``prefix``, ``n_words``, ``hit_runs`` (word numbers first, end, ...), ``items`` and ``near_items`` (sorted ids)."""
    spark = docs.sparkSession
    segments, segments_path = common.write_scratch(_segments(benchmark, window), "benchmark-segments")
    index = build_index(docs, keep, term_filter(segments), window, slack)
    total = segments.agg(F.sum(F.length("tokens"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    hits, path = common.write_scratch(_no_hits(spark), "hits")
    for b in range(blocks):
        mine = segments.where(F.pmod(F.xxhash64("item", "tokens"), F.lit(blocks)) == b)
        _search(index, [(r.item, bytes(r.tokens)) for r in mine.collect()], window, slack, path)
    common.drop_scratch(spark, segments_path)
    hits = _merged(spark.read.schema(hits.schema).parquet(path))
    hits = common.written_side(hits, "document-hits")
    common.drop_scratch(spark, path)
    rows = index.select("shard", F.posexplode("docs").alias("doc", "d"))
    rows = rows.join(hits, (F.col("shard") == F.col("h_shard")) & (F.col("doc") == F.col("h_doc")), "left")
    none = {"hit_runs__": "array<int>", "items__": "array<string>", "near_items__": "array<string>"}
    made = {"n_words__": F.col("d.n_words__"), **{c: F.coalesce(c, F.array().cast(t)) for c, t in none.items()}}
    names = {c: prefix + c.removesuffix("__") for c in made}
    return rows.select(*(F.col("d")[c].alias(c) for c in keep if c not in names.values()), *(x.alias(names[c]) for c, x in made.items()))


def n_hit() -> Column:
    """Words in hit runs."""
    return F.expr("aggregate(sequence(1, size(hit_runs) div 2), 0L, (n, k) -> if(size(hit_runs) = 0, 0L, n + hit_runs[2 * k - 1] - hit_runs[2 * k - 2]))")
