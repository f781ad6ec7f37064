"""Alignment of announcements to the last bar before and the first tradable bar after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators.asof import asof_join

# fixed values: why an announcement is left out, in order of precedence
NO_CLOCK = "no usable timestamp in DissemDT, DT_TM or NEWS_DT"
NO_SYMBOL = "scrip code outside the supplied five symbols"
NO_NEXT = "no tradable bar after dissemination within the data window"
NO_PREVIOUS = "no bar precedes dissemination within the data window"
BAD_PRICE = "non-positive pre-announcement price"


def nearest_bars(events: DataFrame, bars: DataFrame, cfg: StudyConfig, time: str = "event_ts") -> DataFrame:
    """``events`` with ``pre`` (last bar that ended by then) and ``nxt`` (first bar from the next whole minute on)."""
    payload = ["ts", "close", "session_date", "bar_seq"]
    rows = events.withColumns(
        {
            "before__": F.col(time) - F.make_dt_interval(mins=F.lit(cfg.bar_minutes)),
            "after__": F.date_trunc("minute", F.col(time) + F.expr("interval 59.999999 second")).cast("timestamp_ntz"),
        }
    )
    rows = asof_join(rows, bars, "symbol", "before__", "ts", payload, "backward", "pre")
    return asof_join(rows, bars, "symbol", "after__", "ts", payload, "forward", "nxt").drop("before__", "after__")


def align_events(announcements: DataFrame, bars: DataFrame, sess: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Each announcement with its alignment, or the first reason to leave it out; no row is dropped.

    ``bars`` are numbered bars. Excluded rows have nulls, but those with a bad price keep their alignment.
    """
    symbols = sess.select(F.col("symbol").alias("known__")).distinct()
    rows = announcements.join(symbols, F.col("symbol") == F.col("known__"), "left")
    rows = nearest_bars(rows, bars, cfg)
    d0 = sess.select(*[F.col(c).alias(f"d0_{c}") for c in ("symbol", "session_date", "session_pos", "n_bars", "last_seq", "n_sessions")])
    rows = rows.join(d0, (F.col("symbol") == F.col("d0_symbol")) & (F.col("nxt.session_date") == F.col("d0_session_date")), "left")
    own = sess.select(F.col("symbol").alias("own_symbol"), F.col("session_date").alias("own_date"))
    rows = rows.join(own, (F.col("symbol") == F.col("own_symbol")) & (F.col("event_ts").cast("date") == F.col("own_date")), "left")
    no_clock = (F.col("ts_source") == "none") | F.col("event_ts").isNull()
    reason = (
        F.when(no_clock, NO_CLOCK).when(F.col("known__").isNull(), NO_SYMBOL).when(F.col("nxt").isNull(), NO_NEXT)
        .when(F.col("pre").isNull(), NO_PREVIOUS).when(F.col("pre.close") <= 0, BAD_PRICE).otherwise("")
    )
    rows = rows.withColumn("exclusion_reason", reason)
    filled = F.col("exclusion_reason").isin("", BAD_PRICE)

    def put(value):
        return F.when(filled, value)

    minute = F.hour("event_ts") * 60 + F.minute("event_ts")
    bucket = F.when(F.col("own_date").isNull(), "non_trading_day").when(minute < cfg.open_minute, "pre_open").when(minute < cfg.close_minute, "in_session").otherwise("after_close")
    left = F.col("d0_last_seq") - F.col("nxt.bar_seq") + 1
    columns = {
        "pre_bar_ts": put(F.col("pre.ts")),
        "pre_close": put(F.col("pre.close")),
        "effective_ts": put(F.col("nxt.ts")),
        "t0_index": put(F.col("nxt.bar_seq")),
        "pre_index": put(F.col("pre.bar_seq")),
        "D0": put(F.col("nxt.session_date")),
        "d0_session_pos": put(F.col("d0_session_pos")),
        "arrival_bucket": put(bucket),
        "tradable_regime": put(F.when((F.col("nxt.session_date") == F.col("event_ts").cast("date")) & (bucket == "in_session"), "in_session").otherwise("at_open")),
        "delay_minutes": put(F.expr("timestampdiff(MICROSECOND, event_ts, nxt.ts)") / F.lit(60e6)),
        "bars_to_session_close": put(left),
        "d0_session_bars": put(F.col("d0_n_bars")),
        "d0_short_session": put(F.col("d0_n_bars") < cfg.bars_per_session),
        "pre_session_date": put(F.col("pre.session_date")),
        "sessions_after_d0": put(F.col("d0_n_sessions") - 1 - F.col("d0_session_pos")),
        **{f"truncated_{k}m": F.coalesce(put(left < k), F.lit(False)) for k in cfg.intraday_windows},
        f"incomplete_{max(cfg.horizons)}d": F.coalesce(put(F.col("d0_n_sessions") - 1 - F.col("d0_session_pos") < max(cfg.horizons)), F.lit(False)),
        "sess_last_index": put(F.col("d0_last_seq")),
    }
    return rows.select(*announcements.columns, "exclusion_reason", *[c.alias(n) for n, c in columns.items()])
