"""Synthetic minute bars and announcements."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import align, sessions
from tidemark.sources import bars as bar_source
from tidemark.sources import scratch

CFG = StudyConfig()
DAYS = [dt.date(2024, 1, d) for d in (2, 3, 4, 5)]
LONG = [*DAYS, dt.date(2024, 1, 8), dt.date(2024, 1, 9)]


def day(d, clock):
    h, m, *s = map(int, clock.split(":"))
    return dt.datetime(2024, 1, d, h, m, *s)


def make_bars(spark, days, minutes=375, symbol="TEST", open_volume=1000.0):
    """Prices from 100 up by a tenth a bar, a thousand in volume, on every minute from 09:15."""
    rows, k = [], 0
    for d in days:
        for i in range(minutes):
            p = 100 + 0.1 * k
            rows.append((symbol, dt.datetime.combine(d, dt.time(9, 15)) + dt.timedelta(minutes=i), p, p + 0.5, p - 0.5, p, open_volume if i == 0 else 1000.0))
            k += 1
    return bar_source.derive(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"))


def make_filings(spark, *stamps, subject="Order Win", priority=3, companion=False, period=None, source="DissemDT", symbol="TEST", first=0):
    rows = [(f"n{first + i}", symbol, t, source, subject, "test", priority, companion, period) for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, "NEWSID string, symbol string, event_ts timestamp_ntz, ts_source string, subject string, subject_rule string, subject_priority int, is_companion boolean, fiscal_period string")


def aligned(spark, filings, bars, cfg=CFG):
    sess = scratch.written(sessions.sessions(bars), "sessions")
    numbered = scratch.written(sessions.number_bars(bars, sess), "bars")
    return scratch.written(align.align_events(filings, numbered, sess, cfg), "aligned"), numbered, sess


def one(df):
    (row,) = df.collect()
    return row


def columns(df, *names):
    return sorted(tuple(r) for r in df.select(*[F.col(n) for n in names]).collect())
