"""Windowed returns, volume and volatility around events, against peers and time-of-day baselines.

Windows are equi-joins on a bar's place along its symbol or a session's place: each event names the places that it needs, so
no join compares all events with all bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators.align import nearest_bars
from tidemark.operators.sessions import full_sessions, log_returns
from tidemark.sources import scratch


def return_names(cfg: StudyConfig) -> list[str]:
    return [*(f"r_{k}m" for k in cfg.intraday_windows), "r_to_close", *(f"r_{h}d" for h in cfg.horizons), *(f"drift_{h}d" for h in cfg.horizons)]


def raw_returns(points: DataFrame, bars: DataFrame, sess: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(key, symbol, returns): for rows (key, symbol, event_ts), re-aligned on the symbol's own bars; nulls past the data's end."""
    near = scratch.written(nearest_bars(points.select("key", "symbol", "event_ts"), bars, cfg), "nearest")  # three joins read it
    near = near.where("pre is not null and nxt is not null and pre.close > 0")
    d0 = sess.select(F.col("symbol").alias("s1"), F.col("session_date").alias("d1"), "session_pos", "last_seq", F.col("close").alias("d0_close"))
    rows = near.join(d0, (F.col("symbol") == F.col("s1")) & (F.col("nxt.session_date") == F.col("d1")))
    rows = rows.select("key", "symbol", F.col("pre.close").alias("pre"), F.col("nxt.bar_seq").alias("i0"), "session_pos", "last_seq", "d0_close")
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.least(F.col("i0") + k - 1, F.col("last_seq")).alias("seq")) for k in cfg.intraday_windows])
    intraday = rows.select("key", "symbol", F.explode(ends).alias("e")).select("key", "symbol", "e.k", "e.seq")
    intraday = intraday.join(bars.select(F.col("symbol").alias("s2"), F.col("bar_seq").alias("q2"), "close"), (F.col("symbol") == F.col("s2")) & (F.col("seq") == F.col("q2")))
    intraday = intraday.groupBy("key", "symbol").agg(*[F.max(F.when(F.col("k") == k, F.col("close"))).alias(f"c_{k}m") for k in cfg.intraday_windows])
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), (F.col("session_pos") + h).alias("pos")) for h in cfg.horizons])
    daily = rows.select("key", "symbol", F.explode(ahead).alias("e")).select("key", "symbol", "e.h", "e.pos")
    daily = daily.join(sess.select(F.col("symbol").alias("s3"), F.col("session_pos").alias("p3"), "close"), (F.col("symbol") == F.col("s3")) & (F.col("pos") == F.col("p3")))
    daily = daily.groupBy("key", "symbol").agg(*[F.max(F.when(F.col("h") == h, F.col("close"))).alias(f"c_{h}d") for h in cfg.horizons])
    rows = rows.join(intraday, ["key", "symbol"]).join(daily, ["key", "symbol"], "left")

    def gain(top: str, base: str) -> Column:
        return F.try_divide(top, base) - 1

    return rows.select(
        "key", "symbol",
        *[gain(f"c_{k}m", "pre").alias(f"r_{k}m") for k in cfg.intraday_windows],
        gain("d0_close", "pre").alias("r_to_close"),
        *[gain(f"c_{h}d", "pre").alias(f"r_{h}d") for h in cfg.horizons],
        *[gain(f"c_{h}d", "d0_close").alias(f"drift_{h}d") for h in cfg.horizons],
    )


def with_peers(events: DataFrame, bars: DataFrame, sess: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(cluster_id, returns, peer_ and adj_ returns): the basket is the mean over the other symbols that have a value.

    Symbols are aligned once for each distinct time, and a time's returns are summed once: an event's basket is that sum less
    its own return, so events that share a time share the work and no event meets its peers one by one.
    """
    listed = sess.agg(F.collect_set("symbol").alias("all"))  # one row: the study's symbols
    times = events.select("event_ts").distinct().join(F.broadcast(listed), F.lit(True))
    points = times.select(F.col("event_ts").alias("key"), F.explode("all").alias("symbol"), "event_ts")
    found = scratch.written(raw_returns(points, bars, sess, cfg), "returns")  # the sums and the events' own
    names = return_names(cfg)
    sums = found.groupBy(F.col("key").alias("at")).agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.sum, F.count)])
    own = events.select("cluster_id", F.col("symbol").alias("own"), "event_ts").join(found, (F.col("own") == F.col("symbol")) & (F.col("event_ts") == F.col("key")))
    rows = own.join(sums, F.col("event_ts") == F.col("at"))

    def peer(n: str) -> Column:
        others = F.col(f"count_{n}") - F.col(n).isNotNull().cast("long")
        return F.when(others > 0, (F.col(f"sum_{n}") - F.coalesce(n, F.lit(0.0))) / others)

    rows = rows.withColumns({f"peer_{n}": peer(n) for n in names})
    return rows.select("cluster_id", *names, *[f"peer_{n}" for n in names], *[(F.col(n) - F.col(f"peer_{n}")).alias(f"adj_{n}") for n in names])


def window_measures(events: DataFrame, bars: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Own volume, share of empty bars, realised volatility and range of each event's windows, clipped at the close."""
    longest = max(cfg.intraday_windows)
    rows = events.select("cluster_id", F.col("symbol").alias("sym"), "t0_index", F.explode(F.sequence("t0_index", F.least(F.col("t0_index") + longest - 1, F.col("sess_last_index")))).alias("seq"))
    own = bars.select("symbol", "bar_seq", "high", "low", "close", "volume", "prev_bar_close")
    rows = rows.join(own, (F.col("sym") == F.col("symbol")) & (F.col("seq") == F.col("bar_seq")))
    ratio = F.try_divide("close", "prev_bar_close")
    rows = rows.withColumns({"j": F.col("seq") - F.col("t0_index"), "sq": F.when(ratio > 0, F.pow(F.ln(ratio), 2))})
    inside = {k: F.col("j") < k for k in cfg.intraday_windows}
    m, name = inside[cfg.main_window], cfg.main
    out = rows.groupBy("cluster_id").agg(
        *[F.sum(F.when(c, F.col("volume"))).alias(f"vol_{k}m") for k, c in inside.items()],
        *[F.avg(F.when(c, (F.col("volume") == 0).cast("double"))).alias(f"zero_vol_share_{k}m") for k, c in inside.items()],
        F.sqrt(F.coalesce(F.sum(F.when(m, F.col("sq"))), F.lit(0.0))).alias(f"rv_{name}"),
        F.max(F.when(m, F.col("high"))).alias("hi"),
        F.min(F.when(m, F.col("low"))).alias("lo"),
    )
    return out.withColumn(f"range_{name}", F.try_divide(F.col("hi") - F.col("lo"), "lo")).drop("hi", "lo")


def baselines(events: DataFrame, bars: DataFrame, sess: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Medians over the up to ``baseline_sessions`` full sessions before D0 of what the same minutes of the day held.

    Null where D0 is not a full session. Each event is joined to its prior sessions by their number.
    """
    full = full_sessions(sess, cfg.bars_per_session)
    grid = log_returns(bars, sess, cfg.bars_per_session).select(F.col("symbol").alias("gs"), F.col("full_pos").alias("gp"), "grid_col", "grid_prev", "sq_log_ret", "high", "low", "close", "volume")
    d0 = full.select(F.col("symbol").alias("fs"), F.col("session_date").alias("fd"), F.col("full_pos").alias("p"), F.col("first_seq").alias("d0_first"))
    base = events.join(d0, (F.col("symbol") == F.col("fs")) & (F.col("D0") == F.col("fd"))).where("p > 0")
    c0 = F.col("t0_index") - F.col("d0_first")
    last = F.lit(cfg.bars_per_session - 1)
    base = base.select("cluster_id", "symbol", "p", c0.alias("c0"), *[F.least(c0 + k - 1, last).alias(f"c1_{k}") for k in cfg.intraday_windows])
    prior = base.withColumn("q", F.explode(F.sequence(F.greatest(F.col("p") - cfg.baseline_sessions, F.lit(0)), F.col("p") - 1)))
    longest = max(cfg.intraday_windows)
    cells = prior.join(grid, (F.col("symbol") == F.col("gs")) & (F.col("q") == F.col("gp")) & F.col("grid_col").between(F.col("c0"), F.col(f"c1_{longest}")))
    inside = {k: F.col("grid_col") <= F.col(f"c1_{k}") for k in cfg.intraday_windows}
    m = inside[cfg.main_window]
    per = cells.groupBy("cluster_id", "q").agg(
        *[F.sum(F.when(c, F.col("volume"))).alias(f"v_{k}") for k, c in inside.items()],
        F.sqrt(F.coalesce(F.sum(F.when(m, F.col("sq_log_ret"))), F.lit(0.0))).alias("rv"),
        F.max(F.when(m, F.col("high"))).alias("hi"), F.min(F.when(m, F.col("low"))).alias("lo"),
        F.max(F.when(F.col("grid_col") == F.col(f"c1_{cfg.main_window}"), F.col("close"))).alias("end"),
        F.max(F.when(F.col("grid_col") == F.col("c0"), F.col("grid_prev"))).alias("begin"),
    )
    per = per.withColumns({"rng": F.try_divide(F.col("hi") - F.col("lo"), "lo"), "ret": F.abs(F.try_divide("end", "begin") - 1)})
    medians = per.groupBy("cluster_id").agg(*[F.median(f"v_{k}").alias(f"vol_base_{k}m") for k in cfg.intraday_windows], F.median("rv").alias("rv_base"), F.median("rng").alias("range_base"), F.median("ret").alias(f"baseline_abs_r_{cfg.main}"))
    daily = base.select("cluster_id", "symbol", F.explode(F.sequence(F.greatest(F.col("p") - cfg.baseline_sessions, F.lit(0)), F.col("p") - 1)).alias("q"))
    daily = daily.join(full.select(F.col("symbol").alias("vs"), F.col("full_pos").alias("vp"), "volume"), (F.col("symbol") == F.col("vs")) & (F.col("q") == F.col("vp")))
    return medians.join(daily.groupBy("cluster_id").agg(F.median("volume").alias("vol_base_d0")), "cluster_id", "left")


def measure(events: DataFrame, bars: DataFrame, sess: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Events with all response measures; events that are left out keep their row with nulls."""
    usable = events.where("exclusion_reason = ''")
    rows = events.join(with_peers(usable, bars, sess, cfg), "cluster_id", "left").join(window_measures(usable, bars, cfg), "cluster_id", "left").join(baselines(usable, bars, sess, cfg), "cluster_id", "left")
    day = sess.select(F.col("symbol").alias("ds"), F.col("session_date").alias("dd"), F.col("volume").alias("vol_d0"))
    rows = rows.join(day, (F.col("symbol") == F.col("ds")) & (F.col("D0") == F.col("dd")), "left").drop("ds", "dd")
    main = cfg.main
    made = {f"vol_ratio_{k}m": F.try_divide(f"vol_{k}m", f"vol_base_{k}m") for k in cfg.intraday_windows}
    made |= {f"rv_ratio_{main}": F.try_divide(f"rv_{main}", "rv_base"), f"range_ratio_{main}": F.try_divide(f"range_{main}", "range_base"), "vol_ratio_d0": F.try_divide("vol_d0", "vol_base_d0")}
    for n in [*(f"r_{k}m" for k in cfg.intraday_windows), "r_to_close"]:
        made |= {f"abs_{n}": F.abs(n), f"abs_adj_{n}": F.abs(f"adj_{n}")}
    return rows.withColumns(made).drop("rv_base", "range_base", "vol_base_d0")
