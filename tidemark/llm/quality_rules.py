"""Quality rules as a short-circuit cascade.

A rule rejects a document or passes it on. Each rule's cost (seconds a document) and the set of rules that reject a
document are measured on a sample of the documents that pass the base rule, since only those enter the cascade. The order is
then built greedily: next comes the rule with the most rejections per cost among the documents that the rules before it
leave. A document leaves the cascade at its first rejection. The verdict is the conjunction of all rules, so it does not
depend on the order that the sample happened to give; only the work does.

The sample is measured where it lies and comes to the driver as one row for each set of rejecting rules.

Defined results: a null text has no words and fails the base rule; an empty text likewise; repeated rows are judged
alike, each on its own; a very long text is judged whole; an empty table gives an empty result; further columns are ignored
unless named in ``keep``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)

#: Words that a document needs, and the percentage of its words that repeated three-word windows may cover.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Documents, on average, that cost and selectivity are estimated on.
SAMPLE_ROWS = 1000


class Counts(NamedTuple):
    """What the base rule has counted of a document already."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_lines: int


@dataclass(frozen=True)
class Rule:
    """``rejects(text, counts)`` looks at one document's UTF-8 bytes."""

    name: str
    rejects: Callable[[bytes, Counts], bool]


def _many_symbols(text: bytes, n: Counts) -> bool:
    return 10 * n.n_symbols > n.n_words


def _shouting(text: bytes, n: Counts) -> bool:
    return 2 * len(text.translate(None, _NOT_UPPER)) > len(text.translate(None, _NOT_LETTER))


def _exclaiming(text: bytes, n: Counts) -> bool:
    return 5 * text.count(b"!") > n.n_words


def _many_digits(text: bytes, n: Counts) -> bool:
    return 10 * len(text.translate(None, _NOT_DIGIT)) > 3 * n.word_chars


def _word_length(text: bytes, n: Counts) -> bool:
    return n.word_chars < 2 * n.n_words or n.word_chars > 15 * n.n_words


def _repeated_lines(text: bytes, n: Counts) -> bool:
    return 2 * n.n_dup_lines > n.n_lines


RULES = (
    Rule("many_symbols", _many_symbols),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("many_digits", _many_digits),
    Rule("word_length", _word_length),
    Rule("repeated_lines", _repeated_lines),
)


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def base_stats(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Word and symbol counts of each row of one chunk."""
    data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
    n = batch.num_rows
    starts, ends, row = common.word_spans(data, offsets)
    n_words = np.bincount(row, minlength=n)
    chars = ~common.SPACE[data] & ((data & 0xC0) != 0x80)
    covered = np.zeros(len(starts), bool)
    if len(starts) > 2:
        h = common.word_hashes(data, starts, ends)
        with np.errstate(over="ignore"):
            key = common.mix(common.mix(h[:-2] + row[:-2].astype(np.uint64)) + h[1:-1])
            key = common.mix(key + h[2:])
        at = np.flatnonzero(row[:-2] == row[2:])
        key = key[at]
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        for k in range(3):
            covered[hit + k] = True
    lines = np.array([dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
    return {
        "n_words": n_words,
        "word_chars": common.per_row(chars, offsets),
        "n_symbols": common.per_row(SYMBOLS[data], offsets),
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": np.bincount(row[covered], minlength=n),
        "n_lines": lines[:, 1],
    }


def counts_of(stats: dict[str, np.ndarray]) -> list[Counts]:
    return [Counts(*x) for x in zip(*(stats[f].tolist() for f in Counts._fields), strict=True)]


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


@dataclass(frozen=True)
class Estimate:
    """A rule, its seconds a document, and the share that it rejects of what the rules before it leave."""

    rule: Rule
    seconds: float
    rejected: float


def ordered(rules: tuple[Rule, ...], seconds: list[float], rejecting: dict[int, int]) -> list[Estimate]:
    """The cascade by rejection per cost. ``rejecting`` counts sample documents by the rules that reject them, as a bit set."""
    left, alive, out = list(range(len(rules))), dict(rejecting), []
    while left:
        total = sum(alive.values())
        share = {k: sum(n for bits, n in alive.items() if bits >> k & 1) / max(total, 1) for k in left}
        best = min(left, key=lambda k: (-share[k] / max(seconds[k], 1e-9), seconds[k], k))
        out.append(Estimate(rules[best], seconds[best], share[best]))
        alive = {bits: n for bits, n in alive.items() if not bits >> best & 1}
        left.remove(best)
    return out


def measure(texts: list[bytes], counts: list[Counts], rules: tuple[Rule, ...]) -> tuple[list[int], list[float]]:
    """The rules that reject each document, as a bit set, and the seconds that each rule took."""
    bits, spent = [0] * len(texts), []
    for k, rule in enumerate(rules):
        began = time.perf_counter()
        found = [rule.rejects(t, n) for t, n in zip(texts, counts, strict=True)]
        spent.append(time.perf_counter() - began)
        bits = [b | bool(x) << k for b, x in zip(bits, found, strict=True)]
    return bits, spent


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Estimate on about ``sample_rows`` rows: those whose text and length hash lowest, whatever the table's layout."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    width = len(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            texts = common.texts_of(batch)
            stats = base_stats(batch, texts)
            counts, passed = counts_of(stats), np.flatnonzero(~base_failed(stats)).tolist()
            bits, spent = measure([texts[i] for i in passed], [counts[i] for i in passed], rules)
            by_bits = Counter(bits)
            n = len(by_bits)
            each = [spent] + [[0.0] * width] * (n - 1) if n else []  # a chunk's seconds count once
            yield pa.RecordBatch.from_arrays([pa.array(list(by_bits), pa.int64()), pa.array(list(by_bits.values()), pa.int64()), pa.array(each, pa.list_(pa.float64()))], names=["bits", "n", "seconds"])

    sample = docs.select("text").where(common.hash_share(share, "text"))
    found = sample.mapInArrow(run, "bits long, n long, seconds array<double>")
    rows = found.groupBy("bits").agg(F.sum("n").alias("n"), *[F.sum(F.get("seconds", F.lit(k))).alias(f"s{k}") for k in range(width)]).collect()  # at most 2^rules rows
    total = max(sum(r.n for r in rows), 1)
    return ordered(rules, [sum(r[f"s{k}"] for r in rows) / total for k in range(width)], {r.bits: r.n for r in rows})


OUT = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("failed_rule", pa.string())])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each document's counts, verdict and the rule that it left the cascade at. One narrow pass, no shuffle."""
    common.small_batches(docs.sparkSession)
    order = [e.rule for e in plan_cascade(docs, rules, sample_rows)]
    kept_fields = [docs.schema[c] for c in keep]
    source = docs.select(*keep, F.col("text")) if "text" not in keep else docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            texts = common.texts_of(batch)
            stats = base_stats(batch, texts)
            failed = base_failed(stats)
            left: list[str | None] = ["base" if x else None for x in failed.tolist()]
            alive = np.flatnonzero(~failed).tolist()
            counts = counts_of(stats)
            for rule in order:
                still = []
                for i in alive:
                    if rule.rejects(texts[i], counts[i]):
                        left[i] = rule.name
                    else:
                        still.append(i)
                alive = still
            verdict = np.zeros(len(texts), bool)
            verdict[alive] = True
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(x, f.type) for x, f in zip((*(stats[c] for c in OUT.names[:5]), failed, verdict, left), OUT, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + made, names=[*keep, *OUT.names])

    types = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields] + [f"{f.name} {types[f.type]}" for f in OUT])
    return source.mapInArrow(run, schema)
