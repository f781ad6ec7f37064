from dataclasses import replace

import pytest

from tests.study_fixtures import CFG, LONG, aligned, day, make_bars, make_filings, one
from tidemark.operators import cluster, impact


def test_returns_and_time_of_day_baseline(spark):
    bars = make_bars(spark, LONG, open_volume=9000.0)
    out, numbered, sess = aligned(spark, make_filings(spark, day(9, "9:00")), bars)
    events = cluster.collapse(cluster.build_clusters(out, CFG), CFG)
    cfg = replace(CFG, intraday_windows=(1, 5, 60))
    r = one(impact.measure(events, numbered, sess, cfg))
    k = 5 * 375
    pre = 100 + 0.1 * (k - 1)
    assert r.r_5m == pytest.approx((100 + 0.1 * (k + 4)) / pre - 1)
    assert r.r_to_close == pytest.approx((100 + 0.1 * (k + 374)) / pre - 1)
    assert r.vol_base_1m == 9000.0 and r.vol_ratio_1m == 1.0 and r.r_1d is None


def test_peer_basket_is_the_mean_of_the_others(spark):
    bars = make_bars(spark, LONG, minutes=30, symbol="A").union(make_bars(spark, LONG, minutes=30, symbol="B"))
    out, numbered, sess = aligned(spark, make_filings(spark, day(5, "9:20"), symbol="A"), bars)
    events = cluster.collapse(cluster.build_clusters(out, CFG), CFG)
    r = one(impact.with_peers(events, numbered, sess, CFG))
    assert r.peer_r_5m == pytest.approx(r.r_5m) and r.adj_r_5m == pytest.approx(0)
