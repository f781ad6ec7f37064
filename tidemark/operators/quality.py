"""The data-quality audit: a long table of check, scope, count, detail and action, and the repair of bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StudyConfig

PRICES = ("open", "high", "low", "close")
NEAR_SECONDS = 300


def _rows(df: DataFrame, check: str, scope: Column, count: Column, detail: Column, action: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), scope.cast("string").alias("scope"), count.cast("long").alias("count"), detail.cast("string").alias("detail"), F.lit(action).alias("action"))


def well_formed() -> Column:
    """low <= open, close <= high; null if a price is."""
    return (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("high") >= F.col("low"))


def repair(bars: DataFrame) -> DataFrame:
    """Bars with high and low widened to hold all prices that are there."""
    return bars.withColumns({"high": F.greatest(*PRICES), "low": F.least(*PRICES)})


def bar_checks(bars: DataFrame, cfg: StudyConfig, duplicates: DataFrame | None = None) -> DataFrame:
    """All checks of bars by symbol. ``duplicates`` are the rows as read, before one bar for each time was kept."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*PRICES, "volume")])
    low = reduce(lambda a, b: a | b, [F.col(c) <= 0 for c in PRICES])
    by = bars.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_distinct("session_date").alias("sessions"), (F.count("ts") - F.count_distinct("ts")).alias("dup"), F.count_if(null).alias("nulls"),
        F.count_if(~F.coalesce(well_formed(), F.lit(False))).alias("bad"), F.count_if(F.col("volume") == 0).alias("zero"), F.count_if(low).alias("low"),
    )
    per = bars.groupBy("symbol", "session_date").agg(F.count("*").alias("n")).where(F.col("n") < cfg.bars_per_session)
    short = per.groupBy("symbol").agg(F.count("*").alias("n_short"), F.array_join(F.array_sort(F.collect_list(F.concat(F.col("session_date").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")))), ", ").alias("days"))
    by = by.join(short, "symbol", "left")
    s, none = F.col("symbol"), F.lit("")
    share = F.concat(F.format_number(100 * F.col("zero") / F.col("n"), 2), F.lit("% of bars"))
    out = [
        _rows(by, "bar_count", s, F.col("n"), F.concat(F.col("sessions").cast("string"), F.lit(" sessions")), "none"),
        _rows(by, "duplicate_timestamps", s, F.col("dup"), none, "first kept"),
        _rows(by, "null_ohlcv", s, F.col("nulls"), none, "kept as null"),
        _rows(by, "malformed_ohlc", s, F.col("bad"), none, "high and low widened"),
        _rows(by, "zero_volume", s, F.col("zero"), share, "kept"),
        _rows(by, "non_positive_price", s, F.col("low"), none, "alignment excludes them"),
        _rows(by, "short_sessions", s, F.coalesce("n_short", F.lit(0)), F.coalesce("days", none), "left out of baselines"),
    ]
    if duplicates is not None:
        raw = duplicates.groupBy("symbol").agg((F.count("ts") - F.count_distinct("ts")).alias("dup"))
        out.append(_rows(raw, "duplicate_timestamps_as_read", s, F.col("dup"), none, "first kept"))
    return reduce(DataFrame.unionAll, out)


def near_duplicates(announcements: DataFrame, seconds: int = NEAR_SECONDS) -> DataFrame:
    """Announcements less than ``seconds`` after one of the same symbol, title and headline."""
    w = Window.partitionBy("symbol", "NEWSSUB", "HEADLINE").orderBy("event_ts", "NEWSID")
    rows = announcements.where("symbol is not null").withColumn("lag_ts", F.lag("event_ts").over(w))
    return rows.where(F.expr("timestampdiff(MICROSECOND, lag_ts, event_ts)") < seconds * 1_000_000).drop("lag_ts")


def announcement_checks(announcements: DataFrame, bars: DataFrame, cfg: StudyConfig, strict: bool = False) -> DataFrame:
    """All checks of the feed. ``strict`` counts clocks as disagreeing only where both are there."""
    a, every = announcements, F.lit("all")
    minute = F.hour("event_ts") * 60 + F.minute("event_ts")
    differ = ~F.coalesce(F.col("DissemDT") == F.col("DT_TM"), F.lit(False))
    differ = F.col("DissemDT") != F.col("DT_TM") if strict else differ
    span = bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    one = a.join(F.broadcast(span), F.lit(True)).agg(
        F.count("*").alias("n"), (F.count("NEWSID") - F.count_distinct("NEWSID")).alias("dup"), F.count_if(F.col("symbol").isNull()).alias("unmapped"), F.count_if(differ).alias("differ"),
        F.count_if((F.col("event_ts") < F.col("lo")) | (F.col("event_ts") > F.col("hi") + F.expr("interval 1 day"))).alias("outside"),
        F.count_if(minute < cfg.open_minute).alias("pre"), F.count_if((minute >= cfg.open_minute) & (minute < cfg.close_minute)).alias("during"),
        F.count_if(minute >= cfg.close_minute).alias("after"), F.count_if(F.dayofweek("event_ts").isin(1, 7)).alias("weekend"),
    )
    near = near_duplicates(a).agg(F.count("*").alias("n"))
    sources = a.groupBy("ts_source").agg(F.count("*").alias("n"))
    none = F.lit("")
    out = [
        _rows(one, "announcement_count", every, F.col("n"), none, "none"),
        _rows(one, "duplicate_newsid", every, F.col("dup"), none, "first kept"),
        _rows(near, "near_duplicates", every, F.col("n"), F.lit(f"gap under {NEAR_SECONDS} s"), "clustering absorbs them"),
        _rows(one, "unmapped_symbol", every, F.col("unmapped"), none, "alignment excludes them"),
        _rows(sources, "timestamp_source", F.col("ts_source"), F.col("n"), none, "none"),
        _rows(one, "timestamp_disagreement", every, F.col("differ"), F.lit("DissemDT and DT_TM"), "DissemDT used"),
        _rows(one, "out_of_coverage", every, F.col("outside"), none, "alignment excludes them"),
        _rows(one, "arrival_pre_open", every, F.col("pre"), none, "none"),
        _rows(one, "arrival_in_session", every, F.col("during"), none, "none"),
        _rows(one, "arrival_after_close", every, F.col("after"), none, "none"),
        _rows(one, "arrival_weekend", every, F.col("weekend"), none, "none"),
    ]
    return reduce(DataFrame.unionAll, out)
