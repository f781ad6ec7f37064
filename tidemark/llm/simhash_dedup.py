"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 bits each carry a vector of GF(2)^(r+1); the mask of table v keeps the bits whose vector has an
odd product with v. Any r differing bits span at most r dimensions, so some non-zero v is orthogonal to all of them,
and in that table the two fingerprints are equal under the mask: every pair within radius r collides in at least one
of the 2^(r+1) - 1 tables. Nothing is left to chance.

Rows are first reduced to distinct fingerprints, so groups of copies cost one row. A bucket with more than
``BUCKET`` distinct fingerprints is not compared pair by pair: its members differ only in the bits that the mask
leaves free, and the same construction over those bits splits it further, again without losing a pair. After
three levels at most 64 distinct values can share a bucket. Buckets yield a spanning forest, not all pairs.

Defined results: a null or empty text has fingerprint zero, linked like any other; a null doc_id is a row like
others and is never a component's id unless all of the component's ids are null; repeated rows share a component;
an empty table gives an empty result; further columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import common, shingle_dedup
from tidemark.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42

#: Distinct fingerprints of a bucket that are compared directly; a larger bucket is split by further masks.
BUCKET = 64


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority of each bit over the XXH64 of all word shingles, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(first), 1 << 16):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and ``fp`` (a signed long) of every row; one narrow pass."""
    common.small_batches(docs.sparkSession)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in common.texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(fps)], names=[*keep, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, fp long")


# ---------------------------------------------------------------- covering masks


def masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over the given bit positions, as signed longs."""
    tables = (1 << (radius + 1)) - 1
    vector = {p: 1 + k % tables for k, p in enumerate(positions)}
    found = [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, tables + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _free(mask: int, positions: list[int]) -> list[int]:
    return [p for p in positions if not (mask >> p) & 1]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a bucket's distinct values."""
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
    left, out = set(range(len(fps))), []
    while left:
        front = [left.pop()]
        while front:
            at = front.pop()
            for x in [x for x in np.flatnonzero(near[at]).tolist() if x in left]:
                left.discard(x)
                out.append((int(fps[at]), int(fps[x])))
                front.append(x)
    return out


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) inside buckets ``fps array<long>`` of bounded size."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [x for fps in batch.column(0) for x in _forest(np.array(fps.as_py(), np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def covering_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links that connect all distinct fingerprints ``fp`` of the table within ``radius`` bits, directly or in steps."""
    if radius != RADIUS:
        raise ValueError("the levels below are laid out for a radius of two bits")

    def keyed(rows: DataFrame, level_masks: list[tuple[int, list[int]]]) -> DataFrame:
        """Rows (t, fp) by table; t is the path of masks taken so far."""
        options = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m")) for t, m in level_masks])
        return rows.select("fp", F.explode(options).alias("o")).select("fp", F.col("o.t").alias("t"), F.col("fp").bitwiseAND(F.col("o.m")).alias("key"))

    everywhere = list(range(BITS))
    paths: dict[int, tuple[int, list[int]]] = {}
    for v, m in enumerate(masks(everywhere, radius)):
        paths[v] = (m, _free(m, everywhere))
    rows = keyed(distinct.select("fp"), [(t, m) for t, (m, _) in paths.items()])
    links, base = None, len(paths)
    for level in range(3):
        count = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumnsRenamed({"t": "t2", "key": "k2"})
        met = rows.join(count, (F.col("t") == F.col("t2")) & (F.col("key") == F.col("k2"))).select("t", "key", "fp", "n")
        if level < 2:
            met, _ = common.write_scratch(met, "buckets")
        small = met.where(F.col("n") <= bucket) if level < 2 else met
        found = _bucket_links(small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps"), radius)
        links = found if links is None else links.union(found)
        if level == 2 or met.where(F.col("n") > bucket).isEmpty():
            break
        # every path of the large buckets goes on with the masks over its own free bits, joined on the path's id
        wider: dict[int, tuple[int, list[int]]] = {}
        nexts = []
        for t, (m, free) in paths.items():
            for v, more in enumerate(masks(free, radius)):
                wider[base * (t + 1) + v] = (m | more, _free(m | more, everywhere))
                nexts.append((t, base * (t + 1) + v, m | more))
        table = F.create_map(*[x for t in paths for x in (F.lit(t), F.array(*[F.struct(F.lit(w).alias("t"), F.lit(m).cast("long").alias("m")) for u, w, m in nexts if u == t]))])
        large = met.where(F.col("n") > bucket)
        rows = large.select("fp", F.explode(F.element_at(table, F.col("t"))).alias("o")).select("fp", F.col("o.t").alias("t"), F.col("fp").bitwiseAND(F.col("o.m")).alias("key"))
        paths, base = wider, base * (base + 1)
    return links


# ---------------------------------------------------------------- components


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, ``fp``, ``component_id`` (the least id reachable over links) and ``root`` of every row.

    ``root`` names the component by its least fingerprint, also where ids are null.
    """
    marked = common.written(fingerprints(docs, (id_col, *keep), shingle), "fingerprints")
    distinct = common.written(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct-fingerprints")
    roots = components(covering_links(distinct, radius))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "first_id", "root")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r")
    own = linked.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("fp_l"), "root", "component_id")
    by_fp = distinct.join(own, F.col("fp") == F.col("fp_l"), "left").select(F.col("fp").alias("fp_k"), F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    by_fp = common.written(by_fp, "components")  # a scan on either side lets Spark split the copies of a hot text
    return marked.join(by_fp, F.col("fp") == F.col("fp_k"), "left").select(id_col, *keep, "fp", "component_id", "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS, percent: int | None = None) -> DataFrame:
    """One row of ``docs`` for each component: that with its least id (null last); of rows alike in id and text, one.

    Documents link by fingerprints within ``radius`` bits; with ``percent``, by that Jaccard similarity of their sets of
    shingles instead, which no radius can promise (see ``shingle_dedup``).
    """
    own_hash = F.xxhash64("text")
    if percent is None:
        marked = near_duplicates(docs.select(id_col, "text", own_hash.alias("th")), id_col, radius, shingle, keep=("th",)).withColumnRenamed(id_col, "id")
    else:
        marked = shingle_dedup.near_copies(docs.select(id_col, "text"), id_col, shingle, percent)
    winner = marked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("w"))
    winner = winner.select(F.col("w.id").alias("won_id__"), F.col("w.th").alias("won_hash__")).distinct()
    winner = common.written_side(winner, "winners")  # a scan on either side lets Spark split a hot id
    kept = docs.join(winner, F.col(id_col).eqNullSafe(F.col("won_id__")) & (own_hash == F.col("won_hash__")), "left_semi")
    return kept.withColumn("own_hash__", own_hash).dropDuplicates([id_col, "own_hash__"]).drop("own_hash__")
