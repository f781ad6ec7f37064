import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import ols, ranks, resample, tails


def test_tails_against_known_values():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_sf(60.0, 10) == pytest.approx(3.6e-9, rel=0.1)
    assert tails.t_two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-14)
    assert tails.binomial_two_sided(0, 5) == pytest.approx(2 / 32)
    assert tails.wilcoxon_exact(0, 5) == pytest.approx(2 / 32)
    assert tails.clopper_pearson(0, 10)[1] == pytest.approx(0.3084971, abs=1e-6)
    assert tails.mde(100, 1.0) == pytest.approx(0.28015852, abs=1e-7)
    assert tails.mde(1, 1.0) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_adjusted_p_values(p):
    adjusted = ranks.benjamini_hochberg(p)
    assert all(a >= x - 1e-15 and a <= 1 for a, x in zip(adjusted, p, strict=True))
    order = np.argsort(p, kind="stable")
    assert (np.diff(np.array(adjusted)[order]) >= -1e-15).all()


def test_mid_ranks_and_kruskal(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=400), 1)
    g = rng.choice(["a", "b", "c", "few"], 400, p=[0.33, 0.33, 0.33, 0.01])
    df = spark.createDataFrame([(str(x), float(y)) for x, y in zip(g, v, strict=True)] + [("a", None)], "g string, v double")
    got = {r.value: r.mid_rank for r in ranks.mid_ranks(df, "v").collect()}
    want = pd.Series(v).rank()
    assert all(got[x] == r for x, r in zip(v, want, strict=True))
    t = ranks.kruskal_test(df, "g", "v")
    kept = pd.DataFrame({"g": g, "v": v})[[x in "abc" for x in g]]
    r = kept.v.rank()
    n = len(kept)
    h = 12 / (n * (n + 1)) * sum(x.sum() ** 2 / len(x) for _, x in r.groupby(kept.g)) - 3 * (n + 1)
    c = kept.v.value_counts()
    h /= 1 - (c**3 - c).sum() / (n**3 - n)
    assert t["H"] == pytest.approx(h) and (t["n"], t["k"]) == (n, 3) and 0 < t["p"] < 1
    assert ranks.kruskal_test(df.where("g = 'a'"), "g", "v")["H"] is None


def test_blocked_interval_is_wider(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), f"b{b}", f"i{b}_{i}", 1) for b, x in enumerate(rng.normal(size=5)) for i in range(10)]
    df = spark.createDataFrame(rows, "v double, b string, i string, one int")
    r = resample.intervals(df, ["one"], "v", "b", 2000, 1, "mean").first()
    assert r.ci_high - r.ci_low > 1.5 * (r.ci_high_naive - r.ci_low_naive)
    few = resample.intervals(df.where("b < 'b2'"), ["one"], "v", "b", 100, 1).first()
    assert few.ci_low is None and few.ci_low_naive is not None


def test_permutation_finds_a_planted_effect_only(spark):
    rng = np.random.default_rng(2)
    for shift, low, high in ((5, 0, 0.01), (0, 0.05, 1.01)):
        rows = [("big", float(x), "S") for x in rng.normal(shift, 1, 40)] + [("small", float(x), "S") for x in rng.normal(0, 1, 40)]
        p = resample.permutation_test(spark.createDataFrame(rows, "g string, v double, s string"), "g", "v", "s", 500, 3).first().p
        assert low <= p < high


def test_clustered_ols_against_dense_algebra(spark):
    rng = np.random.default_rng(5)
    n = 300
    g, f, c = rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 25, n)
    y = 0.5 * (g == 1) + rng.normal(size=25)[c] + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), f"g{b}", f"f{d}", f"c{e}") for a, b, d, e in zip(y, g, f, c, strict=True)], "y double, g string, f string, c string")
    got = ols.clustered_ols(df, "y", "g", "f", "c")
    x = np.column_stack([np.ones(n), g == 1, g == 2, f == 1]).astype(float)
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    s = np.array([(x[c == k] * e[c == k, None]).sum(0) for k in range(25)])
    cov = inv @ s.T @ s @ inv * (25 / 24) * ((n - 1) / (n - 4))
    assert got["F"] == pytest.approx(float(b[1:3] @ np.linalg.solve(cov[1:3, 1:3], b[1:3]) / 2))
    assert got["r_squared"] == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum())
    assert got["df2"] == 24


def test_one_sample(spark):
    v = [0.3, -0.1, 0.5, 0.2, 0.9, 0.05, None]
    t = ranks.one_sample(spark.createDataFrame([(1, x) for x in v], "g int, v double"), ["g"], "v").first()
    x = np.array(v[:-1])
    assert t["n"] == 6 and t["p_sign"] == pytest.approx(14 / 64) and t["p_wilcoxon"] == pytest.approx(6 / 64)
    assert t["p_ttest"] == pytest.approx(tails.t_two_sided(x.mean() / (x.std(ddof=1) / math.sqrt(6)), 5))
    assert ranks.one_sample(spark.createDataFrame([(1, 1.0)], "g int, v double"), ["g"], "v").first()["p_ttest"] is None
