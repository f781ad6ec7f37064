"""Drift after financial results, signed by the first reaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.functions import ranks, resample, tails
from tidemark.plans.summary import usable

SUBJECT, POOLED = "Financial Results", "POOLED"


def pead_events(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Results with a reaction: R0, its direction (null for none), and raw and adjusted drift signed by the raw direction."""
    rows = usable(events).where((F.col("subject") == SUBJECT) & F.col("r_to_close").isNotNull())
    direction = F.nullif(F.signum("r_to_close"), F.lit(0.0))
    made = {"R0": F.col("r_to_close"), "R0_adj": F.col("adj_r_to_close"), "direction": direction, "block_m": resample.block_label(20)}
    for h in cfg.horizons:
        made |= {f"signed_drift_{h}d": direction * F.col(f"drift_{h}d"), f"signed_adj_drift_{h}d": direction * F.col(f"adj_drift_{h}d")}
    return rows.withColumns(made).select("cluster_id", "symbol", "D0", *made)


def long_drift(pead: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(scope, measure, horizon_sessions, drift, block_m): each event once under its symbol and once pooled."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(h).alias("h"), F.col(f"{p}_{h}d").alias("v")) for m, p in (("raw", "signed_drift"), ("peer_adjusted", "signed_adj_drift")) for h in cfg.horizons])
    rows = pead.select("symbol", "block_m", F.explode(cells).alias("c")).withColumn("scope", F.explode(F.array(F.lit(POOLED), "symbol")))
    return rows.select("scope", F.col("c.measure").alias("measure"), F.col("c.h").alias("horizon_sessions"), F.col("c.v").alias("drift"), "block_m")


def drift_aggregates(pead: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Location of drift by scope, measure and horizon; 0 is the signed first reaction and -1 its size."""
    rows = long_drift(pead, cfg)
    d = F.col("drift")
    out = rows.groupBy("scope", "measure", "horizon_sessions").agg(F.count("drift").alias("n_events"), F.avg(d).alias("mean_drift"), F.median(d).alias("median_drift"), F.stddev_samp(d).alias("sd"), F.avg((d > 0).cast("double")).alias("continuation_rate"), F.count_if(d > 0).alias("n_continued"))
    first = F.array(*[F.struct(F.lit(f"{m} | initial reaction {n}").alias("measure"), F.lit(h).alias("h"), (F.col(c) if h == 0 else F.abs(c)).alias("v")) for m, c in (("raw", "R0"), ("peer_adjusted", "R0_adj")) for h, n in ((0, "R0 (signed)"), (-1, "|R0|"))])
    r0 = pead.select(F.explode(first).alias("c")).groupBy(F.lit(POOLED).alias("scope"), F.col("c.measure").alias("measure"), F.col("c.h").alias("horizon_sessions")).agg(
        F.count("c.v").alias("n_events"), F.avg("c.v").alias("mean_drift"), F.median("c.v").alias("median_drift"), F.stddev_samp("c.v").alias("sd"), F.lit(None).cast("double").alias("continuation_rate"), F.lit(None).cast("long").alias("n_continued"),
    )
    return out.unionByName(r0)


def pead_summary(pead: DataFrame, cfg: StudyConfig) -> DataFrame:
    """drift_aggregates() with intervals and tests, all cells in one plan."""
    rows = long_drift(pead, cfg)
    keys = ["scope", "measure", "horizon_sessions"]
    tests = ranks.one_sample(rows, keys, "drift", "block_m", cfg.bootstrap_iters, cfg.seed, cfg.alpha)
    z = tails.normal_quantile(1 - cfg.alpha / 2) + tails.normal_quantile(0.8)
    detectable = F.when(F.col("n") >= 2, z * F.col("sd") / F.sqrt("n"))
    tests = tests.select(*keys, "t_stat", "p_ttest", "p_wilcoxon", F.col("p_sign").alias("p_sign_vs_50pct"), detectable.alias("min_detectable_effect"), "ci_low", "ci_high", "ci_low_naive", "ci_high_naive")
    out = drift_aggregates(pead, cfg).join(tests, keys, "left")
    return out.withColumn("significant_blocked", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))).orderBy("measure", "scope", "horizon_sessions")


def drift_persistence(summary: DataFrame, measure: str = "raw") -> DataFrame:
    """One row: the last significant horizon, how many are, and the least detectable effect at the longest."""
    rows = summary.where((F.col("scope") == POOLED) & (F.col("measure") == measure) & (F.col("horizon_sessions") > 0))
    sig = F.col("significant_blocked")
    return rows.agg(F.coalesce(F.max(F.when(sig, F.col("horizon_sessions"))), F.lit(0)).alias("last_significant_horizon"), F.array_sort(F.collect_list("horizon_sessions")).alias("horizons_tested"), F.count_if(sig).alias("n_significant"), F.max_by("min_detectable_effect", "horizon_sessions").alias("smallest_detectable_at_longest"))
