"""Closing-price panels by session, in long form, and what drift checks derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_panel(bars: DataFrame) -> DataFrame:
    """(symbol, session_date, close): the last close of each session."""
    return bars.groupBy("symbol", "session_date").agg(F.max_by("close", "ts").alias("close"))


def dense(panel: DataFrame) -> DataFrame:
    """The panel on all dates by all symbols, with ``pos`` on the shared dates; absent closes are null."""
    dates = panel.select("session_date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("session_date")) - 1).cast("int"))  # one row a date
    symbols = panel.agg(F.collect_set("symbol").alias("all"))
    grid = dates.join(F.broadcast(symbols), F.lit(True)).select("session_date", "pos", F.explode("all").alias("symbol"))
    return grid.join(panel, ["symbol", "session_date"], "left").select("symbol", "session_date", "pos", "close")


def forward_returns(grid: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """fwd_k = close k dates on over close, less 1; null where either is absent."""
    w = Window.partitionBy("symbol").orderBy("pos")
    return grid.withColumns({f"fwd_{k}": F.try_divide(F.lead("close", k).over(w), F.col("close")) - 1 for k in horizons})


def adjusted(forward: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """adj_k: the forward return less the others' sum over one less than the number of symbols; an absent peer adds nothing."""
    w = Window.partitionBy("session_date")
    n = F.count("*").over(w)
    return forward.withColumns({f"adj_{k}": F.col(f"fwd_{k}") - F.try_divide(F.coalesce(F.sum(f"fwd_{k}").over(w), F.lit(0.0)) - F.col(f"fwd_{k}"), n - 1) for k in horizons})


def eligible_sessions(grid: DataFrame, events: DataFrame, radius: int, longest: int) -> DataFrame:
    """(symbol, pos): ordinary sessions, more than ``radius`` from any of the symbol's events, by a left anti join on places."""
    dates = grid.select("session_date", "pos").distinct()
    placed = events.select(F.col("symbol").alias("es"), F.col("D0")).join(dates, F.col("D0") == F.col("session_date")).select("es", F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("bp")).distinct()
    w = Window.partitionBy("symbol").orderBy("pos")
    last = grid.agg((F.max("pos") + 1).alias("n_dates"))
    known = grid.withColumn("has_r0", F.lag("close").over(w).isNotNull() & F.col("close").isNotNull())
    known = known.join(F.broadcast(last), F.lit(True)).where(F.col("has_r0") & (F.col("pos") >= 1) & (F.col("pos") < F.col("n_dates") - longest))
    return known.join(placed, (F.col("symbol") == F.col("es")) & (F.col("pos") == F.col("bp")), "left_anti").select("symbol", "pos")


def placed_events(grid: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster_id, symbol, p): events that have a session before theirs."""
    dates = grid.select("session_date", "pos").distinct()
    return events.select("cluster_id", "symbol", "D0").join(dates, F.col("D0") == F.col("session_date")).select("cluster_id", "symbol", F.col("pos").alias("p")).where("p >= 1")


def busy_peers(grid: DataFrame, events: DataFrame, lookback: int, horizons: tuple[int, ...]) -> DataFrame:
    """(cluster_id, symbol, p, k, peer): other symbols with an event of their own from ``lookback`` sessions before to k after.

    Events meet by place, so the rows are as many as events have neighbours.
    """
    placed = placed_events(grid, events)
    dates = grid.select("session_date", "pos").distinct()
    all_placed = events.select("symbol", "D0").join(dates, F.col("D0") == F.col("session_date"))
    own = all_placed.select(F.col("symbol").alias("peer"), F.col("pos").alias("op")).distinct()
    own = own.select("peer", "op", F.explode(F.sequence(F.col("op") - max(horizons), F.col("op") + lookback)).alias("seen"))
    near = placed.join(own, (F.col("p") == F.col("seen")) & (F.col("symbol") != F.col("peer"))).withColumn("k", F.explode(F.array(*map(F.lit, (0, *horizons)))))
    return near.where(F.col("op").between(F.col("p") - lookback, F.col("p") + F.col("k"))).select("cluster_id", "symbol", "p", "k", "peer").distinct()


def clean_peers(grid: DataFrame, events: DataFrame, lookback: int, horizons: tuple[int, ...]) -> DataFrame:
    """(cluster_id, symbol, p, k, peer): peers without an event of their own nearby, listed; baskets are made without this list."""
    symbols = grid.agg(F.collect_set("symbol").alias("all"))
    rows = placed_events(grid, events).join(F.broadcast(symbols), F.lit(True)).select("cluster_id", "symbol", "p", F.explode("all").alias("peer")).where("peer <> symbol")
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, (0, *horizons)))))
    return rows.join(busy_peers(grid, events, lookback, horizons), ["cluster_id", "symbol", "p", "k", "peer"], "left_anti")
