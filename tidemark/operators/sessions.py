"""Sessions and the places of bars in them.

Positions across a symbol are made in two steps: bars are numbered within their session, and sessions, of which there are
few, are summed up along the symbol. No window sorts all bars of a symbol in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(bars: DataFrame) -> DataFrame:
    """A row for each symbol and session: place, first and last bar, length, volume, close and the close before."""
    per = bars.groupBy("symbol", "session_date").agg(
        F.count("*").alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum("volume").alias("volume"), F.max_by("close", "ts").alias("close"), F.min_by("open", "ts").alias("open"),
    )
    w = Window.partitionBy("symbol").orderBy("session_date")
    whole = Window.partitionBy("symbol")
    return per.withColumns(
        {
            "session_pos": (F.row_number().over(w) - 1).cast("int"),
            "n_sessions": F.count("*").over(whole),
            "first_seq": F.sum("n_bars").over(w) - F.col("n_bars"),
            "last_seq": F.sum("n_bars").over(w) - 1,
            "prev_close": F.lag("close").over(w),
        }
    )


def number_bars(bars: DataFrame, sess: DataFrame) -> DataFrame:
    """Bars with bar_seq (from 0 along the symbol), bar_in_session, and their session's place and length."""
    w = Window.partitionBy("symbol", "session_date").orderBy("ts")
    rows = bars.withColumns({"bar_in_session": (F.row_number().over(w) - 1).cast("int"), "lag_close": F.lag("close").over(w)})
    rows = rows.join(sess.select("symbol", "session_date", "session_pos", "n_bars", "first_seq", "last_seq", "prev_close"), ["symbol", "session_date"])
    rows = rows.withColumn("bar_seq", F.col("first_seq") + F.col("bar_in_session"))
    return rows.withColumn("prev_bar_close", F.coalesce("lag_close", "prev_close")).drop("lag_close")


def full_sessions(sess: DataFrame, bars_per_session: int) -> DataFrame:
    """Sessions with exactly all bars, numbered among themselves, with the close of the full session before."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    rows = sess.where(F.col("n_bars") == bars_per_session)
    return rows.withColumns({"full_pos": (F.row_number().over(w) - 1).cast("int"), "prev_full_close": F.lag("close").over(w)})


def log_returns(bars: DataFrame, sess: DataFrame, bars_per_session: int) -> DataFrame:
    """Bars of full sessions with the previous close on that grid and the log return with its square."""
    full = full_sessions(sess, bars_per_session)
    w = Window.partitionBy("symbol", "session_date").orderBy("ts")
    rows = bars.join(full.select("symbol", "session_date", "full_pos", "prev_full_close"), ["symbol", "session_date"])
    rows = rows.withColumn("grid_col", (F.row_number().over(w) - 1).cast("int")).withColumn("grid_prev", F.coalesce(F.lag("close").over(w), F.col("prev_full_close")))
    ratio = F.try_divide("close", "grid_prev")
    rows = rows.withColumn("log_ret", F.when(ratio > 0, F.ln(ratio)))
    return rows.withColumn("sq_log_ret", F.col("log_ret") * F.col("log_ret"))
