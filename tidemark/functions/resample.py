"""Resampling that follows one random stream: bootstrap intervals and permutation tests.

Each group's values go to one task, since the stream is sequential; groups are events, of which a study has thousands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS: dict[str, Callable] = {"median": np.median, "mean": np.mean}

#: Values drawn at one time, so that a large group's resamples are never held all at once.
DRAWN = 1 << 21


def _stat(stat: str | Callable) -> Callable:
    return STATS[stat] if isinstance(stat, str) else stat


def bootstrap(values: np.ndarray, iters: int, seed: int, stat: str | Callable = "median", alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Percentile interval from samples of single values; none below three."""
    if len(values) < 3:
        return None, None
    rng, of, step = np.random.default_rng(seed), _stat(stat), max(1, DRAWN // len(values))
    found = np.concatenate([of(values[rng.integers(0, len(values), (min(step, iters - i), len(values)))], axis=1) for i in range(0, iters, step)])
    low, high = np.percentile(found, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def block_bootstrap(values: np.ndarray, blocks: np.ndarray, iters: int, seed: int, stat: str | Callable = "median", alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Percentile interval from samples of whole blocks, in order of their labels; none below three blocks."""
    labels, code = np.unique(blocks.astype(str), return_inverse=True)
    if len(labels) < 3:
        return None, None
    members = [np.flatnonzero(code == k) for k in range(len(labels))]
    rng, of, found = np.random.default_rng(seed), _stat(stat), np.empty(iters)
    for i in range(iters):
        found[i] = of(values[np.concatenate([members[k] for k in rng.integers(0, len(labels), len(labels))])])
    low, high = np.percentile(found, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def block_label(horizon: int, symbol: str = "symbol", day: str = "D0") -> Column:
    """Symbol and day for horizons within a session or one session on, else symbol and month."""
    return F.concat_ws("|", symbol, F.date_format(day, "yyyy-MM-dd" if horizon <= 1 else "yyyy-MM"))


def intervals(rows: DataFrame, by: list[str], column: str, block: str, iters: int, seed: int, stat: str = "median", alpha: float = 0.05) -> DataFrame:
    """``by``, blocked ci_low and ci_high, and naive ci_low_naive and ci_high_naive of every group."""
    kept = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("v"), F.col(block).alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["b", "v"])
        v = pdf["v"].to_numpy()
        head = {c: [pdf[c].iloc[0]] for c in by}
        low, high = block_bootstrap(v, pdf["b"].to_numpy(), iters, seed, stat, alpha)
        low_n, high_n = bootstrap(v, iters, seed, stat, alpha)
        return pd.DataFrame(head | {"ci_low": [low], "ci_high": [high], "ci_low_naive": [low_n], "ci_high_naive": [high_n]}).astype({c: float for c in ("ci_low", "ci_high", "ci_low_naive", "ci_high_naive")})

    types = dict(kept.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "ci_low double", "ci_high double", "ci_low_naive double", "ci_high_naive double"])
    found = kept.groupBy(*by).applyInPandas(run, schema)
    return found.select(*by, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("ci_low", "ci_high", "ci_low_naive", "ci_high_naive")])


def median_spread(values: np.ndarray, code: np.ndarray, k: int) -> float:
    """The greatest of the group medians less the least."""
    return float(np.ptp([np.median(values[code == g]) for g in range(k)]))


def permutation_test(rows: DataFrame, group: str, column: str, stratum: str, iters: int, seed: int, min_n: int = 10) -> DataFrame:
    """One row: the spread of group medians, and how often labels shuffled within strata give one as large.

    Observed and p are null where fewer than two groups have ``min_n`` values; without any value there is no row.
    """
    kept = rows.where(F.col(column).isNotNull() & F.col(group).isNotNull() & F.col(stratum).isNotNull()).select(F.col(group).alias("g"), F.col(column).cast("double").alias("v"), F.col(stratum).alias("s"))
    big = kept.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= min_n).select(F.col("g").alias("g2"))
    kept = kept.join(F.broadcast(big), F.col("g") == F.col("g2"), "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "g", "v"])
        labels, code = np.unique(pdf["g"].astype(str).to_numpy(), return_inverse=True)
        v = pdf["v"].to_numpy()
        if len(labels) < 2:
            return pd.DataFrame({"observed": [None], "p": [None], "n": [len(v)], "k": [len(labels)]}).astype({"observed": float, "p": float})
        strata = [np.flatnonzero((pdf["s"] == s).to_numpy()) for s in sorted(pdf["s"].unique())]
        observed, rng, at_least = median_spread(v, code, len(labels)), np.random.default_rng(seed), 0
        for _ in range(iters):
            mixed = code.copy()
            for at in strata:
                mixed[at] = rng.permutation(code[at])
            at_least += median_spread(v, mixed, len(labels)) >= observed
        return pd.DataFrame({"observed": [observed], "p": [(at_least + 1) / (iters + 1)], "n": [len(v)], "k": [len(labels)]})

    found = kept.groupBy(F.lit(1).alias("one")).applyInPandas(run, "observed double, p double, n long, k long")
    return found.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("observed", "p")], "n", "k")
