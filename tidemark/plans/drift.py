"""Checks of drift: a placebo null from ordinary sessions, and peers free of events of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.functions import ranks, resample
from tidemark.operators import panel as panels


def signed_sessions(grid: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(symbol, pos, signed_k): every session's adjusted drift, signed by its own adjusted first move."""
    hs = tuple(sorted({1, *horizons}))
    rows = panels.adjusted(panels.forward_returns(grid, hs), hs)
    r0 = F.lag("adj_1").over(Window.partitionBy("symbol").orderBy("pos"))
    return rows.withColumn("r0", r0).select("symbol", "session_date", "pos", "r0", *[(F.signum("r0") * F.col(f"adj_{k}")).alias(f"signed_{k}") for k in horizons])


def placebo_pool(grid: DataFrame, events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Eligible ordinary sessions with their signed drifts, for symbols that have events."""
    ok = panels.eligible_sessions(grid, events, cfg.exclusion_radius, max(cfg.horizons))
    signed = signed_sessions(grid, cfg.horizons)
    rows = ok.join(signed, ["symbol", "pos"]).where("r0 is not null")
    return rows.join(events.select(F.col("symbol").alias("es")).distinct(), F.col("symbol") == F.col("es"), "left_semi")


def placebo_null(grid: DataFrame, pead: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Where observed mean drift lies among means over ordinary sessions, drawn with each symbol's number of events.

    Draws follow one stream across horizons, so the pool of the few symbols' sessions goes to one task.
    """
    pool = placebo_pool(grid, pead, cfg).select("symbol", "pos", *[f"signed_{k}" for k in cfg.horizons])
    counts = {r.symbol: r.n for r in pead.groupBy("symbol").agg(F.count("*").alias("n")).collect()}  # one row a symbol
    observed = pead.agg(*[F.avg(f"signed_adj_drift_{k}d").alias(f"o_{k}") for k in cfg.horizons]).first()
    horizons, iters, seed = cfg.horizons, cfg.placebo_iters, cfg.seed
    means = [observed[f"o_{k}"] for k in horizons]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        by = {s: g.sort_values("pos") for s, g in pdf.groupby("symbol")}
        for k, mean in zip(horizons, means, strict=True):
            pools = [(by[s][f"signed_{k}"].to_numpy(float), n) for s, n in sorted(counts.items()) if s in by]
            draws = np.array([np.nanmean(np.concatenate([rng.choice(v, n) for v, n in pools])) for _ in range(iters)])
            low, high = np.nanpercentile(draws, [2.5, 97.5])
            centre = np.nanmean(draws)
            real = mean is not None
            out.append((k, mean, centre, np.nanstd(draws, ddof=1), low, high, bool(real and (mean < low or mean > high)), float(np.mean(np.abs(draws - centre) >= abs(mean - centre))) if real else None, iters))
        return pd.DataFrame(out, columns=["horizon_sessions", "observed_mean_drift", "placebo_mean", "placebo_sd", "placebo_low", "placebo_high", "outside_placebo_95", "p_value_vs_placebo", "n_replications"])

    return pool.groupBy(F.lit(1).alias("one")).applyInPandas(run, "horizon_sessions int, observed_mean_drift double, placebo_mean double, placebo_sd double, placebo_low double, placebo_high double, outside_placebo_95 boolean, p_value_vs_placebo double, n_replications int")


def clean_peer_events(grid: DataFrame, pead: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Each event's drift against clean peers: the first move's basket is clean up to D0, each drift's up to its horizon.

    A basket is the sum over all symbols of a session less the event's own symbol and the symbols with events nearby, so no
    event meets all symbols. A peer without a value counts as a peer but adds nothing; an event without any clean peer at D0
    has a count of 0 there and no others.
    """
    hs = cfg.horizons
    w = Window.partitionBy("symbol").orderBy("pos")
    fwd = panels.forward_returns(grid, hs).withColumn("fwd_0", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    values = fwd.select(F.col("symbol").alias("vs"), F.col("pos").alias("vp"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"fwd_{k}").alias("v")) for k in (0, *hs)])).alias("x")).select("vs", "vp", F.col("x.k").alias("vk"), F.col("x.v").alias("v"))
    totals = values.groupBy(F.col("vp").alias("tp"), F.col("vk").alias("tk")).agg(F.count("*").alias("t_peers"), F.count("v").alias("t_n"), F.sum("v").alias("t_sum"))
    placed = panels.placed_events(grid, pead).withColumn("k", F.explode(F.array(*map(F.lit, (0, *hs)))))
    near = panels.busy_peers(grid, pead, cfg.peer_lookback, hs)
    at = (F.col("p") == F.col("vp")) & (F.col("k") == F.col("vk"))
    busy = near.join(values, (F.col("peer") == F.col("vs")) & at).groupBy("cluster_id", "symbol", "p", "k").agg(F.count("*").alias("b_peers"), F.count("v").alias("b_n"), F.sum("v").alias("b_sum"))
    own = placed.join(values, (F.col("symbol") == F.col("vs")) & at).select("cluster_id", "symbol", "p", "k", "v")
    rows = own.join(totals, (F.col("p") == F.col("tp")) & (F.col("k") == F.col("tk"))).join(busy, ["cluster_id", "symbol", "p", "k"], "left")

    def zero(c: str):
        return F.coalesce(c, F.lit(0))

    left = F.col("t_n") - zero("b_n") - F.col("v").isNotNull().cast("long")
    basket = F.when(left > 0, (F.col("t_sum") - zero("b_sum") - zero("v")) / left)
    rows = rows.select("cluster_id", "symbol", "p", "k", (F.col("t_peers") - 1 - zero("b_peers")).alias("n_peers"), (F.col("v") - basket).alias("d"))
    out = rows.groupBy("cluster_id", "symbol", "p").agg(
        F.max(F.when(F.col("k") == 0, F.col("d"))).alias("R0_clean"), F.max(F.when(F.col("k") == 0, F.col("n_peers"))).alias("n_clean_peers"),
        *[F.max(F.when(F.col("k") == k, F.col("d"))).alias(f"d_{k}") for k in hs], *[F.max(F.when(F.col("k") == k, F.col("n_peers"))).alias(f"n_{k}") for k in hs],
    )
    dates = grid.select(F.col("pos").alias("gp"), F.col("session_date").alias("D0")).distinct()
    out = out.join(dates, F.col("p") == F.col("gp"))
    sign, some = F.signum("R0_clean"), F.col("n_clean_peers") > 0
    return out.select("cluster_id", "symbol", "D0", "R0_clean", "n_clean_peers", *[F.when(some, F.col(f"n_{k}")).alias(f"n_clean_peers_{k}d") for k in hs], *[(sign * F.col(f"d_{k}")).alias(f"signed_clean_drift_{k}d") for k in hs])


def clean_peer_drift(grid: DataFrame, pead: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Drift against clean peers, a row a horizon, all horizons in one plan."""
    rows = clean_peer_events(grid, pead, cfg).withColumn("block_m", resample.block_label(20))
    cells = F.array(*[F.struct(F.lit(k).alias("h"), F.col(f"signed_clean_drift_{k}d").alias("v"), F.col(f"n_clean_peers_{k}d").alias("n")) for k in cfg.horizons])
    long = rows.select("block_m", F.explode(cells).alias("c")).select(F.col("c.h").alias("horizon_sessions"), F.col("c.v").alias("v"), F.col("c.n").alias("peers"), "block_m")
    tests = ranks.one_sample(long, ["horizon_sessions"], "v", "block_m", cfg.bootstrap_iters, cfg.seed, cfg.alpha)
    total = pead.agg(F.count("*").alias("total"))
    counts = long.groupBy("horizon_sessions").agg(F.median("peers").alias("median_clean_peers")).join(F.broadcast(total), F.lit(True))
    low, high = F.col("ci_low"), F.col("ci_high")
    return counts.join(tests, "horizon_sessions", "left").select(
        "horizon_sessions", F.coalesce("n", F.lit(0)).cast("long").alias("n_events"), F.col("mean").alias("mean_drift"), F.col("median").alias("median_drift"), F.col("share_positive").alias("continuation_rate"),
        low.alias("ci_low_blocked"), high.alias("ci_high_blocked"), "p_wilcoxon", F.coalesce((low > 0) | (high < 0), F.lit(False)).alias("significant_blocked"), "median_clean_peers", (F.col("total") - F.coalesce("n", F.lit(0))).alias("events_dropped_no_clean_peer"),
    )
