import datetime as dt

import pytest

from tests.study_fixtures import DAYS, aligned, day, make_bars, make_filings, one
from tidemark.operators import align
from tidemark.operators.asof import asof_join


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark, DAYS).cache()


CASES = [
    ("3 10:23:40", "3 10:24", "3 10:22", "in_session", "in_session"),
    ("3 10:24:00", "3 10:24", "3 10:23", "in_session", "in_session"),
    ("3 18:00:00", "4 9:15", "3 15:29", "after_close", "at_open"),
    ("3 7:30:00", "3 9:15", "2 15:29", "pre_open", "at_open"),
    ("3 15:29:30", "4 9:15", "3 15:28", "in_session", "at_open"),
]


def stamp(text):
    d, clock = text.split()
    return day(int(d), clock)


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_nearest_bars(spark, bars, case):
    at, effective, pre, bucket, regime = case
    out, _, _ = aligned(spark, make_filings(spark, stamp(at)), bars)
    r = one(out)
    assert (r.effective_ts, r.arrival_bucket, r.tradable_regime, r.exclusion_reason) == (stamp(effective), bucket, regime, "")
    assert r.pre_bar_ts == stamp(pre)


def test_no_bar_is_used_that_had_not_ended(spark, bars):
    stamps = [dt.datetime(2024, 1, 3, h, m, s) for h in (9, 11, 15) for m in (14, 15, 29, 59) for s in (0, 1, 59)]
    out, _, _ = aligned(spark, make_filings(spark, *stamps), bars)
    for r in out.collect():
        assert r.pre_bar_ts + dt.timedelta(minutes=1) <= r.event_ts <= r.effective_ts


def test_holiday(spark):
    bars = make_bars(spark, [dt.date(2024, 1, 4), dt.date(2024, 1, 5), dt.date(2024, 1, 9)])
    out, _, _ = aligned(spark, make_filings(spark, day(8, "11:00")), bars)
    r = one(out)
    assert (r.arrival_bucket, r.effective_ts, r.tradable_regime) == ("non_trading_day", day(9, "9:15"), "at_open")


def test_truncation(spark, bars):
    out, _, _ = aligned(spark, make_filings(spark, day(3, "15:00")), bars)
    r = one(out)
    assert (r.bars_to_session_close, r.truncated_30m, r.truncated_60m) == (30, False, True)


def test_reasons_in_order_and_no_row_dropped(spark, bars):
    rows = make_filings(spark, None, source="none").union(make_filings(spark, day(3, "10:00"), symbol="NONE", first=1)).union(make_filings(spark, day(9, "10:00"), first=2)).union(make_filings(spark, day(2, "9:00"), first=3)).union(make_filings(spark, day(3, "10:00"), symbol=None, first=4))
    out, _, _ = aligned(spark, rows, bars)
    got = {r.NEWSID: (r.exclusion_reason, r.effective_ts) for r in out.collect()}
    assert got == {"n0": (align.NO_CLOCK, None), "n1": (align.NO_SYMBOL, None), "n2": (align.NO_NEXT, None), "n3": (align.NO_PREVIOUS, None), "n4": (align.NO_SYMBOL, None)}


def test_asof_over_empty_buckets_and_ties(spark):
    left = spark.createDataFrame([("a", dt.datetime(2024, 1, 20)), ("a", dt.datetime(2023, 1, 1)), ("b", dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1)), ("a", None)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", dt.datetime(2024, 1, 2), 1), ("a", dt.datetime(2024, 1, 2), 2), ("a", dt.datetime(2024, 3, 2), 3), ("a", None, 4)], "k string, u timestamp_ntz, v int")
    back = {(r.k, r.t): r.x and r.x.v for r in asof_join(left, right, "k", "t", "u", ["v"], "backward", "x").collect()}
    ahead = {(r.k, r.t): r.x and r.x.v for r in asof_join(left, right, "k", "t", "u", ["v"], "forward", "x").collect()}
    a, early = ("a", dt.datetime(2024, 1, 20)), ("a", dt.datetime(2023, 1, 1))
    assert (back[a], back[early], ahead[a], ahead[early]) == (2, None, 3, 1)
    assert len(back) == len(ahead) == 5 and back["b", dt.datetime(2024, 1, 1)] is back["a", None] is ahead[None, dt.datetime(2024, 1, 1)] is None
