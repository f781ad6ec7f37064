"""The near-duplicate operator at a given similarity: SimHash first, then what no radius of fingerprints can promise.

The covering tables of ``simhash_dedup`` nominate sets of word shingles by their fingerprints, and an exact Jaccard comparison
decides. No Hamming radius of a 64-bit fingerprint is sure to hold all pairs of a given similarity, so the sets that SimHash left
apart are then searched by a prefix filter, which loses no pair at the bound or above:

1. A text's set is the 64-bit hashes of its runs of ``SHINGLE`` words, A-Z lower-cased; a shorter text is one run. Texts with
   equal sets are one row from here on.
2. Sets whose fingerprints are equal or met in a covering table are compared; those similar become components.
3. Two sets of similarity t or more share at least t of the larger, so in any one order of all shingles they share one of
   the first n - ceil(t n) + 1 of each, and the places of their first common one bound what they can share. The order puts the
   shingles that a fixed share of the documents repeats last, the most repeated at the end, so that common passages hardly make
   candidates however large the table is; the sample has no effect on what is found.
4. Each set is compared with the least set that it shares such a shingle with, which makes a large group of near copies one
   component by as many pairs as it has members; then sets are compared with the least of each shingle, and at last all pairs
   that share one, always only those that still lie in different components.
5. Before texts are read again, two sets are compared by parities: each shingle turns over one bit of a sketch of about as many
   bits as the set has shingles, so sketches differ in no more bits than the sets in shingles. Pairs whose sketches differ in
   more than similar sets may are dropped; for the others the sets are made again from the texts, in whole.

Defined results: null and empty texts share the empty set; a null id comes last; of rows alike in id and text one stays; an
empty table gives an empty result; further columns pass through unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, simhash_dedup
from tidemark.llm.components import components

#: Words of a shingle, and the similarity of near copies in percent.
SHINGLE, PERCENT = 5, 80

#: The sample that finds common shingles: so many documents, and this share of them at least, so that the groups of a shingle
#: that it misses stay as small in a larger table.
SAMPLE, SHARE = 4000, 1 / 16

#: Bits of a shingle's hash by which it is known as common.
SLOT_BITS = 24

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def shingles(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each row, in that order."""
    data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
    data = _FOLD[data]
    starts, ends, row = common.word_spans(data, offsets)
    n_words = np.bincount(row, minlength=batch.num_rows)
    words = common.word_hashes(data, starts, ends)
    first = np.cumsum(n_words) - n_words
    left = (first + n_words)[row] - np.arange(len(row))  # words from here to the end of the row
    at = np.flatnonzero((left >= shingle) | (np.arange(len(row)) == first[row]))
    size = np.minimum(left[at], shingle)
    hashes = size.astype(np.uint64)
    for k in range(shingle):
        inside = size > k
        hashes[inside] = common.mix(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + words[at[inside] + k])
    order = np.lexsort((hashes, row[at]))
    r, h = row[at][order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _whole(rows: DataFrame, key: str, shingle: int) -> DataFrame:
    """``key`` (long) and ``grams``, all shingles, of rows (key, text)."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            row, h = shingles(batch, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(h, np.bincount(row, minlength=batch.num_rows))], names=[key, "grams"])

    return rows.select(key, "text").mapInArrow(run, f"{key} long, grams array<long>")


def _sketches(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parities of each row's shingles by the low bits of their hashes, in a power of two of bits: 64, and n at least."""
    bits = np.int64(64) << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
    ends = np.cumsum(bits)
    at = (ends - bits)[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd.astype(bool), bitorder="little"))])


def _differing(a: bytes, b: bytes) -> int:
    """The bits in which two sketches differ, the longer one folded to the length of the other."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _common(docs: DataFrame, shingle: int) -> bytes:
    """How common the shingles of each slot are in a sample of distinct texts: 0 to 3 a byte, compressed."""
    share = min(1.0, max(SHARE, SAMPLE / max(docs.count(), 1)))
    some = docs.where(common.hash_share(share, "text")).select(F.xxhash64("text").alias("k"), "text").dropDuplicates(["k"])
    seen = _whole(some, "k", shingle).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 2")
    level = F.when(F.col("n") < 8, 1).when(F.col("n") < 64, 2).otherwise(3).cast("byte")
    found = seen.select(F.shiftrightunsigned("g", 64 - SLOT_BITS).cast("int").alias("slot"), level.alias("level")).groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return zlib.compress(table.tobytes(), 1)


def _prefixes(docs: DataFrame, id_col: str, shingle: int, percent: int) -> DataFrame:
    """(id, th, set, n, sketch, prefix): hash, size and parities of each row's set, and its shingles that a partner must share one of."""
    levels = _common(docs, shingle)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(levels), np.uint8)
        for batch in common.chunks(batches):
            row, h = shingles(batch, shingle)
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h + np.uint64(1)), dtype=np.uint64)])
            end = np.cumsum(n)
            whole = common.mix(total[end] - total[end - n] + n.astype(np.uint64))
            # 62 bits of the hash below two of the level, of which the higher is turned over as these are sorted as signed numbers
            level = table[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
            key = (h >> np.uint64(2)) | ((level ^ np.uint64(2)) << np.uint64(62))
            order = np.lexsort((key.view(np.int64), row))
            place = np.arange(len(h)) - (end - n)[row]
            size = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
            taken = key[order][place < size[row]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int32)), _sketches(row, h, n), _lists(taken, size)], names=["id", "th", "set", "n", "sketch", "prefix"]
            )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, th long, set long, n int, sketch binary, prefix array<long>"
    return docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether sets whose first common shingle is at these places can be similar; structs of n (shingles) and at (place)."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")).cast("long")
    return rest * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")).cast("long") * percent


def _agreeing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not already differ in more than similar sets may."""
    left, right = (sets.select(F.col("set").alias(f"{x}2"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.distinct().join(left, F.col("a") == F.col("a2")).join(right, F.col("b") == F.col("b2"))
    total = (F.col("na") + F.col("nb")).cast("long")
    both = both.select("a", "b", (total - 2 * F.ceil(total * percent / (100 + percent))).alias("most"), "sa", "sb").where("most >= 0")

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most, sa, sb = (batch.column(k).to_pylist() for k in (2, 3, 4))
            fits = pa.array([_differing(x, y) <= m for m, x, y in zip(most, sa, sb, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(fits)

    return both.mapInArrow(run, "a long, b long")


def _nominated(source: DataFrame, marked: DataFrame, shingle: int) -> DataFrame:
    """Pairs of sets (a, b) by SimHash: those of one fingerprint with the least of them, and the least of linked fingerprints."""
    fps = simhash_dedup.fingerprints(source, ("id", "th"), shingle).select(F.col("id").alias("id2"), F.col("th").alias("th2"), "fp").distinct()
    held = marked.distinct().join(fps, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("set", "fp").distinct()
    held = common.written(held, "set-fingerprints")
    least = common.written(held.groupBy("fp").agg(F.min("set").alias("first")), "distinct-fingerprints")
    one, two = (least.select(F.col("fp").alias(f"{x}_fp"), F.col("first").alias(f"{x}_set")) for x in "ab")
    links = simhash_dedup.covering_links(least.select("fp")).distinct()
    across = links.join(one, F.col("a") == F.col("a_fp")).join(two, F.col("b") == F.col("b_fp")).select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    within = held.join(one, F.col("fp") == F.col("a_fp")).select(F.col("a_set").alias("a"), F.col("set").alias("b"))
    return across.union(within).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) that the links do not connect yet."""
    roots = common.written(components(links), "roots-so-far")
    own, other = (roots.select(F.col("node").alias(f"{x}_node"), F.col("root").alias(f"{x}_root")) for x in "ab")
    pairs = pairs.distinct().join(own, F.col("a") == F.col("a_node"), "left").join(other, F.col("b") == F.col("b_node"), "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, marked: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs of sets (a, b) whose similarity is at the bound or above, written."""
    pairs, path = common.write_scratch(_agreeing(pairs, sets, percent), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    first = marked.join(wanted, F.col("set") == F.col("w"), "left_semi").groupBy("set").agg(F.min(F.struct("id", "th")).alias("at"))
    first = common.written_side(first.select("set", F.col("at.id").alias("eid"), F.col("at.th").alias("eth")), "candidates")
    texts = source.join(first, F.col("id").eqNullSafe(F.col("eid")) & (F.col("th") == F.col("eth"))).select("set", "text")
    grams, grams_path = common.write_scratch(_whole(texts, "set", shingle).dropDuplicates(["set"]), "candidate-sets")
    left, right = (grams.select(F.col("set").alias(f"{x}2"), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = pairs.join(left, F.col("a") == F.col("a2")).join(right, F.col("b") == F.col("b2"))
    shared = F.size(F.array_intersect("ga", "gb")).cast("long")
    found = common.written(both.where(shared * (100 + percent) >= (F.size("ga") + F.size("gb")).cast("long") * percent).select("a", "b"), "similar-pairs")
    common.drop_scratch(source.sparkSession, path)
    common.drop_scratch(source.sparkSession, grams_path)
    return found


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the job that wrote them ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def near_copies(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``id``, ``th`` (the text's hash) and ``root`` of every row; rows linked by similar sets, in steps, share a root."""
    with _shuffles_dropped(docs.sparkSession):
        return _near_copies(docs, id_col, shingle, percent)


def _near_copies(docs: DataFrame, id_col: str, shingle: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    full, full_path = common.write_scratch(_prefixes(docs, id_col, shingle, percent), "prefixes")
    marked = common.written(full.select("id", "th", "set"), "marked")
    since = common.mark()
    sets = common.written(full.select("set", "n", "sketch", "prefix").dropDuplicates(["set"]), "sets")
    common.drop_scratch(spark, full_path)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), "text")

    # SimHash first; what follows finds the pairs beyond its radius
    links = _linked(_nominated(source, marked, shingle), sets, marked, source, shingle, percent)

    tokens = sets.select("set", "n", F.posexplode("prefix").alias("at", "g"))
    same = Window.partitionBy("g")
    met = tokens.select("g", F.struct("n", "set", "at").alias("x")).select("g", "x", F.min("x").over(same).alias("least"), F.max("x").over(same).alias("most"))
    members = common.written(met.where("least <> most").drop("most"), "members")

    # one partner for each set first: a large group of near copies becomes one component by as many pairs as it has members
    met = members.where((F.col("x.set") != F.col("least.set")) & _possible("least", "x", percent))
    nearest = met.groupBy(F.col("x.set").alias("b")).agg(F.min("least").alias("l")).select(F.col("l.set").alias("a"), "b")
    links = common.written(links.union(_linked(_apart(nearest, links), sets, marked, source, shingle, percent)), "partner-links")
    stars = met.select(F.col("least.set").alias("a"), F.col("x.set").alias("b"))
    links = common.written(links.union(_linked(_apart(stars, links), sets, marked, source, shingle, percent)), "star-links")
    roots = components(links).withColumnsRenamed({"node": "k", "root": "r"})
    rooted = common.written(members.drop("least").join(roots, F.col("x.set") == F.col("k"), "left").select("g", "x", F.coalesce("r", "x.set").alias("root")), "rooted-members")
    apart = rooted.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("g").alias("g2"))
    open_ = rooted.join(apart, F.col("g") == F.col("g2"), "left_semi")
    one, two = (open_.select(F.col("g").alias(f"g{x}"), F.col("x").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    pairs = one.join(two, (F.col("ga") == F.col("gb")) & (F.col("a.set") < F.col("b.set")) & (F.col("ra") != F.col("rb")) & _possible("a", "b", percent))
    links = links.union(_linked(pairs.select(F.col("a.set").alias("a"), F.col("b.set").alias("b")), sets, marked, source, shingle, percent))
    roots = common.written_last(components(links).withColumnsRenamed({"node": "k", "root": "r"}), "components", since)
    return marked.join(roots, F.col("set") == F.col("k"), "left").select("id", "th", F.coalesce("r", "set").alias("root"))
