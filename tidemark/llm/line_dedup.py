"""Near-duplicate line removal by a deletion-neighbourhood join, with DataFrame functions only.

A line is removed if an equal one stands earlier in the corpus, by (doc_id, line number), or, where it has ``near_chars``
characters or more, one within ``edits`` edits of it that has as many; the earliest stays. Blank lines hold nothing to
repeat and stay. ``edits`` is 1, or 0 for equal lines alone. The steps:

1. Lines are reduced to distinct ones by hash, with their earliest place; copies are one row from here on.
2. Two lines within one edit agree on the first or on the last half of the shorter one. Lines that share no such half
   with another line have no neighbour and leave here; no pair is lost.
3. The rest emit their deletion neighbourhood: themselves, and all variants with one character deleted, as hashed keys
   with the place of the deletion. The keys of a line are made in one running pass over its characters, so a very long
   line costs as many steps as it has characters.
4. Equal keys join. Lines with a variant in common that was deleted at the same place differ by a substitution there;
   a line that equals another's variant differs by an insertion. All members of such a group are within one edit of
   its earliest, so the group needs its least place and no pairs. A group has at most one member for each character
   that can stand in one place, whatever the corpus.
5. The edit distance of each line and the earliest neighbour found is verified on the texts.

The bound is 1 because a line's neighbourhood grows with its length to the power of the bound; ``near_chars`` is there because
one edit makes another line of a short one ("Chapter 1", "Chapter 2").

Defined results: a null text has no lines and stays null; an empty text is one blank line; rows that share an id are told
apart by their text, and rows alike in both are the same place, which is never earlier than itself; null ids come
first; an empty table gives an empty result; further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

EDITS, NEAR_CHARS = 1, 20

_PLACE = ("id", "th", "line_no")
_LINE = ("h1", "h2", "len")


def _lines(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, th, line_no, line) of all lines that can be duplicates."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")) != "")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.select(*_PLACE, F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.length("line").alias("len"), "line")


def _half_keys(line: Column, size: Column) -> Column:
    """Hashes of the first and the last half, for the line as the shorter and as the longer of a pair."""
    keys = []
    for shorter in (size, size - 1):
        half = F.floor(shorter / 2).cast("int")
        keys += [F.xxhash64(shorter, F.lit(0), F.substring(line, F.lit(1), half)), F.xxhash64(shorter, F.lit(1), F.substring(line, size - half + 1, half))]
    return F.array(*keys)


_KEYS = "array<struct<size:int,key:bigint,cut:int>>"


def _place() -> Column:
    return F.struct(*_PLACE)


def _neighbourhood(texts: DataFrame) -> DataFrame:
    """(size, key, cut) and the line's own columns: its deletion variants, and itself at cut 0.

    Only the half that a partner need not share is cut: where the first halves are equal the edit lies behind them, and
    the other way round. Lines are dealt out before they become characters, so that the windows need no exchange.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = texts.repartition(n, *_LINE).select(*_LINE, "first", "head_shared", "tail_shared", F.posexplode(F.split("line", "")).alias("at", "c")).where("c <> ''")
    every = Window.partitionBy(*_LINE)
    before = every.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = F.floor((F.col("len") - 1) / 2)
    wanted = (F.col("head_shared") & (F.col("at") >= half)) | (F.col("tail_shared") & (F.col("at") < F.col("len") - half))
    chars = chars.select(*_LINE, "first", wanted.alias("wanted"), "at", F.xxhash64("c", "at").alias("here"), F.xxhash64("c", F.col("at") - 1).alias("left"))
    # the running sums take in the deleted character twice or not at all, so it cancels
    chars = chars.withColumns({"head": F.bit_xor("here").over(before), "tail": F.bit_xor("left").over(before), "whole_left": F.bit_xor("left").over(every), "whole": F.bit_xor("here").over(every)})
    variant = F.col("head").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("whole_left")).bitwiseXOR(F.col("tail"))
    keys = F.when(F.col("wanted"), F.array(F.struct((F.col("len") - 1).alias("size"), variant.alias("key"), (F.col("at") + 1).alias("cut"))).cast(_KEYS)).otherwise(F.array().cast(_KEYS))
    itself = F.when(F.col("at") == 0, F.array(F.struct(F.col("len").alias("size"), F.col("whole").alias("key"), F.lit(0).alias("cut"))).cast(_KEYS)).otherwise(F.array().cast(_KEYS))
    return chars.select(*_LINE, "first", F.explode(F.concat(keys, itself)).alias("k")).select(*_LINE, "first", "k.*")


def earlier_neighbours(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, len, earliest): the earliest place of a line one edit away that comes before the line's own first."""
    keys = distinct.select(*_LINE, "first", F.posexplode("halves").alias("side", "half"))  # lines that are too short have no halves
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select(F.col("half").alias("half2"))
    suspects = keys.join(shared, F.col("half") == F.col("half2"), "left_semi")
    suspects = suspects.groupBy(*_LINE, "first").agg(F.max(F.col("side") % 2 == 0).alias("head_shared"), F.max(F.col("side") % 2 == 1).alias("tail_shared"))
    named = suspects.select(*(F.col(c).alias(f"s_{c}") for c in _LINE), "first", "head_shared", "tail_shared")
    named = common.written_side(named, "suspects")
    on = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("line_no") == F.col("first.line_no")) & (F.xxhash64("line") == F.col("s_h1"))
    texts = lines.join(named, on).select(*(F.col(f"s_{c}").alias(c) for c in _LINE), "first", "head_shared", "tail_shared", "line").dropDuplicates(list(_LINE))
    texts = common.written(texts, "suspect-lines")
    who = F.struct("first", *_LINE)
    near = _neighbourhood(texts).withColumn("who", who)
    same, cut = Window.partitionBy("size", "key"), Window.partitionBy("size", "key", "cut")
    near = near.select(
        "who",
        "cut",
        F.min("who").over(cut).alias("peer"),
        F.min(F.when(F.col("cut") == 0, F.col("who"))).over(same).alias("shorter"),
        F.min(F.when(F.col("cut") > 0, F.col("who"))).over(same).alias("longer"),
    )
    best = F.when(F.col("cut") == 0, F.col("longer")).otherwise(F.least("peer", "shorter"))
    found = near.withColumn("best", best).where(F.col("best.first") < F.col("who.first")).groupBy("who").agg(F.min("best").alias("best"))
    left = texts.select(*(F.col(c).alias(f"a_{c}") for c in _LINE), F.col("line").alias("a"))
    right = texts.select(*(F.col(c).alias(f"b_{c}") for c in _LINE), F.col("line").alias("b"))
    pairs = found.join(left, [F.col(f"who.{c}") == F.col(f"a_{c}") for c in _LINE]).join(right, [F.col(f"best.{c}") == F.col(f"b_{c}") for c in _LINE])
    return pairs.where(F.levenshtein("a", "b", EDITS).between(0, EDITS)).select("who.h1", "who.h2", "who.len", F.col("best.first").alias("earliest"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """(rid__, rth__, gone__ array<int>), written: the numbers of the lines that each document loses."""
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1")
    since = common.mark()
    lines = _lines(docs, id_col)
    hashed = common.written(_hashed(lines).select(*_PLACE, *_LINE, F.when(F.col("len") >= near_chars, _half_keys(F.col("line"), F.col("len"))).alias("halves")), "lines")
    distinct = hashed.groupBy(*_LINE, "halves").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    distinct = common.written(distinct, "distinct-lines")
    least = distinct.where("n > 1").select(*_LINE, F.col("first").alias("stays"))
    if edits:
        near = earlier_neighbours(distinct, lines).select(*(F.col(c).alias(f"n_{c}") for c in _LINE), "earliest")
        least = distinct.join(near, [F.col(c) == F.col(f"n_{c}") for c in _LINE], "left").where("n > 1 or earliest is not null").select(*_LINE, F.least("first", "earliest").alias("stays"))
    least = least.select(*(F.col(c).alias(f"d_{c}") for c in _LINE), "stays")
    least = common.written_side(least, "kept-lines")  # a scan on either side lets Spark split the occurrences of a hot line
    gone = hashed.join(least, [F.col(c) == F.col(f"d_{c}") for c in _LINE]).where(_place() > F.col("stays"))
    gone = gone.groupBy(F.col("id").alias("rid__"), F.col("th").alias("rth__")).agg(F.collect_set("line_no").alias("gone__"))
    return common.written_last(gone, "gone-lines", since)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """``docs`` with ``text`` without the removed lines, and ``gone__``, their numbers (null: none)."""
    gone = removed_lines(docs.select(id_col, "text"), id_col, near_chars, edits)
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("rid__")) & (F.xxhash64("text") == F.col("rth__")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone__"))
    kept = F.array_join(F.transform(left, lambda k: F.get(F.col("lines__"), k)), "\n")
    made = joined.withColumn("lines__", F.when(F.col("gone__").isNotNull(), lines)).withColumn("text", F.when(F.col("gone__").isNull(), F.col("text")).otherwise(kept))
    return made.select(*docs.columns, "gone__")
