"""Descriptive and rank statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import resample, tails

#: Buckets that values are cut into, so that ranking them needs no single task.
BUCKETS = 64


def describe(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, sd, quartiles and the share of positive values, nulls left out."""
    v = F.col(column)
    return values.where(v.isNotNull()).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"),
        F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), F.avg((v > 0).cast("double")).alias("share_positive"),
    )


def share_of_all(condition: Column) -> Column:
    """The share of all rows, a null condition counting as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def mid_ranks(values: DataFrame, column: str) -> DataFrame:
    """(value, ties, mid_rank) of the distinct values, equal ones sharing their average rank.

    Values are counted first, cut at approximate quantiles into buckets, and ranked within their bucket after the buckets'
    totals; no window holds more than one bucket.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("ties"))
    edges = counted.agg(F.percentile_approx("value", [k / BUCKETS for k in range(1, BUCKETS)], 10_000)).first()[0] or []
    edges = sorted(set(edges))
    at = reduce(add, [(F.col("value") > e).cast("int") for e in edges], F.lit(0))  # no lambda: both sides of the join below share it
    counted = counted.withColumn("bucket", at)
    totals = counted.groupBy("bucket").agg(F.sum("ties").alias("n"))
    before = totals.select(F.col("bucket").alias("b2"), (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # at most BUCKETS rows
    w = Window.partitionBy("bucket").orderBy("value")
    ranked = counted.withColumn("upto", F.sum("ties").over(w)).join(F.broadcast(before), F.col("bucket") == F.col("b2"))
    return ranked.select("value", "ties", (F.col("before") + F.col("upto") - (F.col("ties") - 1) / 2.0).alias("mid_rank"))


def _group_ranks(values: DataFrame, group: str, column: str, min_n: int) -> tuple[DataFrame, DataFrame]:
    """(grp, n, rank_sum) of the groups with ``min_n`` values, and one row with total and ties."""
    rows = values.where(F.col(column).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(column).cast("double").alias("v"))
    cells = rows.groupBy("grp", "v").agg(F.count("*").alias("c"))
    big = cells.groupBy("grp").agg(F.sum("c").alias("n")).where(F.col("n") >= min_n)
    cells = cells.join(big.select(F.col("grp").alias("g2"), "n"), F.col("grp") == F.col("g2"))
    flat = rows.join(big.select(F.col("grp").alias("g3")), F.col("grp") == F.col("g3"), "left_semi")
    ranks = mid_ranks(flat, "v")
    joined = cells.join(ranks, F.col("v") == F.col("value"))
    groups = joined.groupBy("grp").agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("mid_rank")).alias("rank_sum"))
    ties = F.col("ties").cast("double")
    total = ranks.agg(F.sum("ties").cast("double").alias("total"), F.sum(ties * ties * ties - ties).alias("tie_term"))
    return groups, total


def kruskal(values: DataFrame, group: str, column: str, min_n: int = 10) -> DataFrame:
    """One row: H corrected for ties, epsilon squared, n and k over groups of ``min_n`` values or more; nulls below two groups."""
    groups, total = _group_ranks(values, group, column, min_n)
    one = groups.agg(F.count("*").alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("ss")).join(F.broadcast(total), F.lit(True))
    n = F.col("total")
    raw = 12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)
    h = F.when(F.col("k") >= 2, F.try_divide(raw, 1 - F.try_divide(F.col("tie_term"), n * n * n - n)))
    return one.select(h.alias("H"), F.try_divide(h - F.col("k") + 1, n - F.col("k")).alias("epsilon_sq"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.col("k").cast("long").alias("k"))


def kruskal_test(values: DataFrame, group: str, column: str, min_n: int = 10) -> dict[str, float | None]:
    """kruskal() with its p-value, as numbers."""
    r = kruskal(values, group, column, min_n).first().asDict()
    return r | {"p": None if r["H"] is None else tails.chi2_sf(r["H"], r["k"] - 1)}


def dunn(values: DataFrame, group: str, column: str, min_n: int = 10) -> DataFrame:
    """Dunn's z of each pair of groups in alphabetical order; a row a pair of groups, of which there are few."""
    groups, total = _group_ranks(values, group, column, min_n)
    groups = groups.withColumn("mean_rank", F.col("rank_sum") / F.col("n"))
    a = groups.select(F.col("grp").alias("group_a"), F.col("n").alias("n_a"), F.col("mean_rank").alias("rank_a"))
    b = groups.select(F.col("grp").alias("group_b"), F.col("n").alias("n_b"), F.col("mean_rank").alias("rank_b"))
    pairs = a.join(b, F.col("group_a") < F.col("group_b")).join(F.broadcast(total), F.lit(True))
    n = F.col("total")
    variance = (n * (n + 1) / 12 - F.col("tie_term") / (12 * (n - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    return pairs.select("group_a", "group_b", "n_a", "n_b", ((F.col("rank_a") - F.col("rank_b")) / F.sqrt(variance)).alias("z"))


def benjamini_hochberg(p: list[float]) -> list[float]:
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, least = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        least = min(least, p[i] * len(p) / rank)
        out[i] = least
    return out


def dunn_bh(values: DataFrame, group: str, column: str, min_n: int = 10) -> DataFrame:
    """dunn() with two-sided p and p adjusted by Benjamini and Hochberg, least first."""
    spark = values.sparkSession
    rows = dunn(values, group, column, min_n).collect()
    p = [2 * tails.normal_sf(abs(r.z)) for r in rows]
    found = sorted(((*r, a, b) for r, a, b in zip(rows, p, benjamini_hochberg(p), strict=True)), key=lambda r: (r[-1], r[0], r[1]))
    return spark.createDataFrame(found, "group_a string, group_b string, n_a long, n_b long, z double, p double, p_bh double")


def signed_ranks(values: DataFrame, column: str) -> DataFrame:
    """One row with Wilcoxon's signed-rank sums of the non-zero values, their number, and the tie term."""
    rows = values.where(F.col(column).isNotNull() & (F.col(column) != 0)).select(F.abs(column).alias("a"), F.col(column).alias("v"))
    ranks = mid_ranks(rows, "a")
    signs = rows.groupBy("a").agg(F.count_if(F.col("v") > 0).alias("up"))
    t = F.col("ties").cast("double")
    return signs.join(ranks, F.col("a") == F.col("value")).agg(F.sum(F.col("up") * F.col("mid_rank")).alias("w_plus"), F.sum("ties").alias("n"), F.sum(t * t * t - t).alias("tie_term"))


def wilcoxon_p(w_plus: float | None, n: int | None, tie_term: float | None, zeros: int = 0) -> float | None:
    """Two-sided: exact for up to 50 values without ties or zeros, else the normal approximation without continuity correction."""
    if not n:
        return None
    if n <= 50 and not tie_term and not zeros:
        return tails.wilcoxon_exact(w_plus, n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return min(1.0, 2 * tails.normal_sf(abs(w_plus - n * (n + 1) / 4) / sd)) if sd else None


def sample_moments(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """``by`` and what tests of location need: describe(), the signs, and signed-rank sums, for all cells in one plan.

    Equal sizes are counted before they are ranked, so a cell's window holds its distinct sizes.
    """
    rows = values.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("v__"))
    moments = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("v__").alias("mean"), F.median("v__").alias("median"), F.stddev_samp("v__").alias("sd"),
        F.percentile("v__", 0.25).alias("q25"), F.percentile("v__", 0.75).alias("q75"), F.count_if(F.col("v__") > 0).alias("n_positive"), F.count_if(F.col("v__") == 0).alias("zeros__"),
    )
    sizes = rows.where("v__ <> 0").groupBy(*by, F.abs("v__").alias("a__")).agg(F.count("*").alias("ties__"), F.count_if(F.col("v__") > 0).alias("up__"))
    t = F.col("ties__").cast("double")
    sizes = sizes.withColumn("mid__", F.sum("ties__").over(Window.partitionBy(*by).orderBy("a__")) - (t - 1) / 2)
    ranked = sizes.groupBy(*by).agg(F.sum(F.col("up__") * F.col("mid__")).alias("w_plus__"), F.sum("ties__").alias("m__"), F.sum(t * t * t - t).alias("tie__"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in by]
    return moments.join(ranked.withColumnsRenamed({c: f"{c}__r" for c in by}), on, "left").drop(*(f"{c}__r" for c in by))


#: What one_sample() adds to a cell's moments.
TESTS = ("t_stat", "p_ttest", "p_wilcoxon", "p_sign")


def _tests(n: int, mean: float, sd: float | None, up: int, zeros: int, w_plus: float | None, m: int | None, tie: float | None) -> tuple[float | None, ...]:
    if n < 3:
        return None, None, None, None
    t = mean / (sd / math.sqrt(n)) if sd else None
    return t, None if t is None else tails.t_two_sided(t, n - 1), wilcoxon_p(w_plus, m, tie, zeros), tails.binomial_two_sided(up, n)


def one_sample(values: DataFrame, by: list[str], column: str, block: str | None = None, iters: int = 0, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Location against zero of every cell: describe(), n_positive, t, Wilcoxon and sign tests, nulls below three values;
    with ``block``, the mean's blocked and naive intervals too. Tails are made on the executors, a row a cell."""
    cells = sample_moments(values, by, column)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [_tests(int(n), mean, None if pd.isna(sd) else sd, int(up), int(z), *(None if pd.isna(x) else x for x in (w, m, tie))) for n, mean, sd, up, z, w, m, tie in zip(*(pdf[c] for c in ("n", "mean", "sd", "n_positive", "zeros__", "w_plus__", "m__", "tie__")), strict=True)]
            yield pdf.drop(columns=["zeros__", "w_plus__", "m__", "tie__"]).assign(**{c: pd.Series([x[k] for x in made], index=pdf.index, dtype=float) for k, c in enumerate(TESTS)})

    kinds = dict(cells.dtypes)
    stats = ("n", "mean", "median", "sd", "q25", "q75", "n_positive")
    found = cells.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, *stats)), *(f"{c} double" for c in TESTS)]))
    present = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("sd", *TESTS)]
    names = {"sd": present[0], **dict(zip(TESTS, present[1:], strict=True))}
    found = found.select(*[names.get(c, F.col(c)) for c in found.columns], F.try_divide("n_positive", "n").alias("share_positive"))
    if block is None:
        return found
    ci = resample.intervals(values, by, column, block, iters, seed, "mean", alpha)
    ci = ci.withColumnsRenamed({c: f"{c}__c" for c in by})
    return found.join(ci, [F.col(c).eqNullSafe(F.col(f"{c}__c")) for c in by], "left").drop(*(f"{c}__c" for c in by))
