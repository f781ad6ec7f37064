"""Queries with random numbers or tail probabilities, against plain NumPy on the measured events, with the study's seed."""

import math
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest

from tidemark.config import HOURLY as C
from tidemark.functions import resample
from tidemark.plans import queries as q
from tidemark.plans import summary

SF = "/root/testdata/sf0.01"
M = C.main
CELL = ["scope", "measure", "horizon_sessions"]


def close(a, b, digits=5):
    a, b = (None if x is None or isinstance(x, float) and math.isnan(x) else x for x in (a, b))
    return a == b or a is not None and b is not None and abs(a - b) <= 10.0**-digits * max(1, abs(a))


def normal_sf(z):
    return math.erfc(z / math.sqrt(2)) / 2


def boot(v, stat, iters=C.bootstrap_iters, seed=C.seed):
    """Percentile interval from samples of single values, all draws at once."""
    v = np.asarray(v, float)
    if len(v) < 3:
        return None, None
    return tuple(np.percentile(stat(v[np.random.default_rng(seed).integers(0, len(v), size=(iters, len(v)))], axis=1), [2.5, 97.5]))


def block_boot(v, blocks, stat, iters=C.bootstrap_iters, seed=C.seed):
    """The same from whole blocks in the order of their labels."""
    groups = [np.asarray(g, float) for _, g in pd.Series(v).groupby(np.asarray(blocks))]
    if len(groups) < 3:
        return None, None
    rng = np.random.default_rng(seed)
    draws = [stat(np.concatenate([groups[k] for k in rng.integers(0, len(groups), size=len(groups))])) for _ in range(iters)]
    return tuple(np.percentile(draws, [2.5, 97.5]))


def frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)


@pytest.fixture(scope="module")
def study(spark):
    return q.study(spark, SF)


@pytest.fixture(scope="module")
def events(study):
    e = frame(study.measured.where("exclusion_reason = ''").withColumn("block_d", resample.block_label(1)).withColumn("block_m", resample.block_label(20)))
    assert len(e) > 50
    return e


@pytest.fixture(scope="module")
def pead(study):
    p = frame(study.pead)
    assert len(p) > 5
    return p


def rows(spark, name):
    return frame(q.QUERIES[name](spark, SF))


def intervals(e, column, block):
    kept = e.dropna(subset=[column]).sort_values([block, column])
    return block_boot(kept[column], kept[block], np.median), boot(kept[column], np.median)


def test_bootstrap_by_slices_follows_one_stream(monkeypatch):
    v = np.random.default_rng(1).normal(size=77)
    whole = resample.bootstrap(v, 300, 5)
    monkeypatch.setattr(resample, "DRAWN", 1000)
    assert resample.bootstrap(v, 300, 5) == whole == pytest.approx(boot(v, np.median, 300, 5))


def test_st_bootstrap_ci(spark, events):
    got = rows(spark, "st_bootstrap_ci").set_index("symbol")
    for symbol, e in events.groupby("symbol"):
        want = [x for pair in intervals(e, f"abs_adj_r_{M}", "block_d") for x in pair]
        assert all(close(a, b) for a, b in zip(got.loc[symbol, ["ci_low", "ci_high", "ci_low_naive", "ci_high_naive"]], want, strict=True))


def strong(r):
    base, med = r[f"baseline_abs_r_{M}"], r[f"median_abs_adj_r_{M}"]
    size = bool(base > 0 and med >= C.strong_return * base)
    volume = bool(r[f"median_vol_ratio_{M}"] >= C.strong_volume)
    evidence = bool(r[f"abs_r_{M}_ci_low"] is not None and r[f"abs_r_{M}_ci_low"] > base)
    return size, volume, evidence, size and volume and evidence


def test_agg_subject_summary_and_its_figures(spark, events):
    got = rows(spark, "agg_subject_summary")
    assert list(got[f"median_abs_adj_r_{M}"].dropna()) == sorted(got[f"median_abs_adj_r_{M}"].dropna(), reverse=True)
    for name in ("fig03_subject_return", "fig04_subject_volume"):
        part = rows(spark, name).set_index("subject")
        for c in part.columns:
            assert all(close(a, b) for a, b in zip(part[c], got.set_index("subject").loc[part.index, c], strict=True))
    got = got.set_index("subject")
    assert set(got.index) == set(events["subject"])
    for subject, e in events.groupby("subject"):
        r = got.loc[subject]
        for column, name in ((f"abs_adj_r_{M}", f"abs_r_{M}"), (f"vol_ratio_{M}", f"vol_ratio_{M}")):
            low, high = intervals(e, column, "block_d")[0]
            assert close(r[f"{name}_ci_low"], low) and close(r[f"{name}_ci_high"], high)
        assert r["n_events"] == len(e) and close(r[f"median_abs_adj_r_{M}"], e[f"abs_adj_r_{M}"].median())
        assert tuple(r[["strong_size", "strong_volume", "strong_evidence", "strong_impact"]]) == strong(r)
        assert r["inference_supported"] == (len(e) >= C.min_events)


def test_strong_rule_on_known_rows(spark):
    known = [("Big", 0.030, 0.005, 5.0, 0.020, True), ("Small", 0.008, 0.005, 1.2, 0.006, False), ("Unsure", 0.030, 0.005, 5.0, None, False)]
    df = spark.createDataFrame(known, f"subject string, median_abs_adj_r_{M} double, baseline_abs_r_{M} double, median_vol_ratio_{M} double, abs_r_{M}_ci_low double, want boolean")
    assert all(r.strong == r.want for r in df.withColumn("strong", summary.strong_prongs(C)["strong_impact"]).collect())


def test_agg_stock_summary(spark, events):
    got = rows(spark, "agg_stock_summary").set_index(["symbol", "subject"])
    cells = {(s, "ALL SUBJECTS"): e for s, e in events.groupby("symbol")} | {k: e for k, e in events.groupby(["symbol", "subject"])}
    assert set(got.index) == set(cells)
    for key, e in cells.items():
        low, high = intervals(e, f"abs_adj_r_{M}", "block_d")[0]
        r = got.loc[key]
        assert r["n_events"] == len(e) and close(r["ci_low"], low) and close(r["ci_high"], high)


def kruskal(e, column, group="subject", least=C.min_events):
    kept = e.dropna(subset=[column])
    kept = kept[kept.groupby(group)[column].transform("size") >= least]
    r, n, k = kept[column].rank(), len(kept), kept[group].nunique()
    if k < 2:
        return None
    ties = kept[column].value_counts()
    h = (12 / (n * (n + 1)) * sum(x.sum() ** 2 / len(x) for _, x in r.groupby(kept[group])) - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
    return h, (h - k + 1) / (n - k), n, k


def chi2_sf(x, df):
    """By integrating the density."""
    t = np.linspace(x, x + 400, 2_000_001)
    f = t ** (df / 2 - 1) * np.exp(-t / 2) / (2 ** (df / 2) * math.gamma(df / 2))
    return float(np.trapezoid(f, t))


def test_agg_robustness_tests(spark, events):
    got = rows(spark, "agg_robustness_tests").set_index("specification")
    cut = events.copy()
    low, high = cut[f"abs_adj_r_{M}"].quantile([0.01, 0.99])
    cut[f"abs_adj_r_{M}"] = cut[f"abs_adj_r_{M}"].clip(low, high)
    for name, e in (("all events", events), ("no overlap", events[~events["overlap_60m"]]), ("winsorised 1/99", cut)):
        want, r = kruskal(e, f"abs_adj_r_{M}"), got.loc[name]
        if want is None:
            assert close(r["H"], None)
        else:
            assert close(r["H"], want[0], 3) and close(r["epsilon_sq"], want[1], 4) and (r["n"], r["k"]) == want[2:] and close(r["p"], chi2_sf(want[0], want[3] - 1), 3)


def test_st_dunn_bh(spark):
    got = rows(spark, "st_dunn_bh")
    e = frame(spark.read.parquet(f"{SF}/events.parquet").select("event_type", "value")).dropna()
    r, n = e["value"].rank(), len(e)
    ties = e["value"].value_counts()
    variance = n * (n + 1) / 12 - (ties**3 - ties).sum() / (12 * (n - 1))
    mean, size = r.groupby(e["event_type"]).mean(), e.groupby("event_type").size()
    names = sorted(mean.index)
    want = [(a, b, (mean[a] - mean[b]) / math.sqrt(variance * (1 / size[a] + 1 / size[b]))) for i, a in enumerate(names) for b in names[i + 1 :]]
    p = [2 * normal_sf(abs(z)) for _, _, z in want]
    adjusted = [min(min(x * len(p) / sum(y <= x for y in p) for x in p if x >= own), 1.0) for own in p]
    expected = {(a, b): (z, x, y) for (a, b, z), x, y in zip(want, p, adjusted, strict=True)}
    assert len(got) == len(expected) and all(x <= y for x, y in pairwise(got["p_bh"]))
    for r in got.itertuples():
        assert all(close(a, b, 4) for a, b in zip((r.z, r.p, r.p_bh), expected[r.group_a, r.group_b], strict=True))


def permuted(e, column, iters=C.permutation_iters, seed=C.seed):
    kept = e.dropna(subset=[column])
    kept = kept[kept.groupby("subject")[column].transform("size") >= C.min_events].sort_values(["symbol", "subject", column])
    if kept["subject"].nunique() < 2:
        return None
    code, v = pd.Categorical(kept["subject"]).codes, kept[column].to_numpy()
    strata = [np.flatnonzero(kept["symbol"] == s) for s in sorted(kept["symbol"].unique())]

    def spread(labels):
        medians = [np.median(v[labels == g]) for g in range(code.max() + 1)]
        return max(medians) - min(medians)

    observed, rng, hits = spread(code), np.random.default_rng(seed), 0
    for _ in range(iters):
        mixed = code.copy()
        for at in strata:
            mixed[at] = rng.permutation(code[at])
        hits += spread(mixed) >= observed
    return observed, (hits + 1) / (iters + 1), len(kept), int(code.max()) + 1


def test_st_permutation(spark, events):
    r, want = rows(spark, "st_permutation").iloc[0], permuted(events, f"abs_adj_r_{M}")
    assert close(r["observed"], want[0]) and close(r["p"], want[1]) and (r["n"], r["k"]) == want[2:]


def test_permutation_of_one_group_says_nothing(spark):
    df = spark.createDataFrame([("a", float(k), "S") for k in range(20)], "g string, v double, s string")
    r = resample.permutation_test(df, "g", "v", "s", 50, 1).first()
    assert (r.observed, r.p, r.n, r.k) == (None, None, 20, 1)
    assert resample.permutation_test(df.where("v < 0"), "g", "v", "s", 50, 1).count() == 0


def least_squares(e, column, block):
    """Dense design, joint F of the subject terms, errors clustered by block."""
    kept = e.dropna(subset=[column])
    gs, fs = sorted(kept["subject"].unique()), sorted(kept["symbol"].unique())
    x = np.column_stack([np.ones(len(kept)), *[(kept["subject"] == g) for g in gs[1:]], *[(kept["symbol"] == f) for f in fs[1:]]]).astype(float)
    y, inv = kept[column].to_numpy(), np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    resid = y - x @ b
    scores = np.array([(x[at] * resid[at, None]).sum(0) for at in kept.reset_index().groupby(block).indices.values()])
    k, n, w = len(scores), len(y), x.shape[1]
    cov = inv @ scores.T @ scores @ inv * (k / (k - 1)) * ((n - 1) / (n - w))
    size, turn = np.linalg.eigh(cov[1 : len(gs), 1 : len(gs)])
    there = size > 1e-9 * size.max()  # a subject with one event has no error
    along = turn[:, there].T @ b[1 : len(gs)]
    return (along**2 / size[there]).sum() / there.sum(), there.sum(), k - 1, n, 1 - resid @ resid / ((y - y.mean()) ** 2).sum()


def test_st_clustered_ols(spark, events):
    r, want = rows(spark, "st_clustered_ols").iloc[0], least_squares(events, f"abs_adj_r_{M}", "block_d")
    assert close(r["F"], want[0], 4) and (r["df1"], r["df2"], r["n"]) == want[1:4] and close(r["r_squared"], want[4])


def test_subject_tests(spark, events):
    got = rows(spark, "subject_tests")
    e = events.copy()
    e["log_vol"] = np.log(e[f"vol_ratio_{M}"].where(e[f"vol_ratio_{M}"] > 0))
    at = 0
    for column in (f"abs_adj_r_{M}", "log_vol", f"rv_ratio_{M}"):
        want = kruskal(e, column)
        assert close(got["statistic"][at], want[0], 3) and (got["n"][at], got["groups"][at]) == want[2:]
        want = permuted(e, column)
        assert close(got["statistic"][at + 1], want[0], 4) and close(got["p_value"][at + 1], want[1]) and got["n"][at + 1] == want[2]
        at += 2
    f = least_squares(e, f"abs_adj_r_{M}", "block_m")
    assert close(got["statistic"][at], f[0], 4) and close(got["effect_size_epsilon_sq"][at], f[4])


def wilcoxon(v):
    """Exact by all sums of ranks where there are few values and neither zeros nor ties, else by the normal approximation."""
    x = v[v != 0]
    n = len(x)
    if not n:
        return None
    r = pd.Series(np.abs(x)).rank().to_numpy()
    w = r[x > 0].sum()
    ties = pd.Series(np.abs(x)).value_counts()
    if len(v) == n <= 50 and (ties == 1).all():
        ways = np.array([1.0])
        for k in range(1, n + 1):
            ways = np.convolve(ways, np.eye(1, k + 1, 0)[0] + np.eye(1, k + 1, k)[0])
        low = min(w, n * (n + 1) / 2 - w)
        return min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    return 2 * normal_sf(abs(w - n * (n + 1) / 4) / sd)


def t_two_sided(t, df):
    x = np.linspace(0, abs(t), 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * float(np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x))


def one_sample(v, blocks):
    v = np.asarray(v, float)
    n, up = len(v), int((v > 0).sum())
    out = {"n": n, "mean": v.mean(), "median": np.median(v), "q25": np.percentile(v, 25), "q75": np.percentile(v, 75), "share_positive": up / n}
    if n < 3:
        return out | {k: None for k in ("t_stat", "p_ttest", "p_wilcoxon", "p_sign", "ci_low", "ci_high", "ci_low_naive", "ci_high_naive")}
    t = v.mean() / (v.std(ddof=1) / math.sqrt(n))
    ways = [math.comb(n, k) / 2**n for k in range(n + 1)]
    kept = pd.DataFrame({"v": v, "b": np.asarray(blocks)}).sort_values(["b", "v"])
    low, high = block_boot(kept["v"], kept["b"], np.mean)
    naive = boot(kept["v"], np.mean)
    return out | {"t_stat": t, "p_ttest": t_two_sided(t, n - 1), "p_wilcoxon": wilcoxon(v), "p_sign": min(1.0, sum(w for w in ways if w <= ways[up] * (1 + 1e-7))), "ci_low": low, "ci_high": high, "ci_low_naive": naive[0], "ci_high_naive": naive[1]}


def same(r, want, names=None):
    return all(close(r[(names or {}).get(k, k)], x, 4) for k, x in want.items() if (names or {}).get(k, k) in r.index)


def test_st_one_sample(spark, events):
    got = rows(spark, "st_one_sample").set_index("symbol")
    for symbol, e in events.groupby("symbol"):
        e = e.dropna(subset=[f"adj_r_{M}"])
        assert same(got.loc[symbol], one_sample(e[f"adj_r_{M}"], e["block_d"]))


@pytest.mark.parametrize("values", [[0.0, 0.4, -0.2, 0.9, 0.0, 0.3], [0.5, -0.5, 0.25, 1.0], [0.1, 0.2, 0.3, 0.4, -0.6], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]])
def test_wilcoxon_with_zeros_and_ties(spark, values):
    from tidemark.functions import ranks

    r = ranks.one_sample(spark.createDataFrame([(1, v) for v in values], "g int, v double"), ["g"], "v").first()
    assert close(r.p_wilcoxon, wilcoxon(np.array(values)))


def drift_cells(pead):
    for measure, prefix in (("raw", "signed_drift"), ("peer_adjusted", "signed_adj_drift")):
        for h in C.horizons:
            kept = pead.dropna(subset=[f"{prefix}_{h}d"])
            yield ("POOLED", measure, h), kept[f"{prefix}_{h}d"], kept["block_m"]
            for symbol, e in kept.groupby("symbol"):
                yield (symbol, measure, h), e[f"{prefix}_{h}d"], e["block_m"]


def test_pead_summary_persistence_and_figures(spark, pead):
    got = rows(spark, "pead_summary").set_index(CELL)
    names = {"n": "n_events", "mean": "mean_drift", "median": "median_drift", "share_positive": "continuation_rate", "p_sign": "p_sign_vs_50pct"}
    z = 1.959963984540054 + 0.8416212335729143
    for key, v, blocks in drift_cells(pead):
        want, r = one_sample(v, blocks), got.loc[key]
        assert same(r, want, names)
        assert close(r["min_detectable_effect"], z * np.std(v, ddof=1) / math.sqrt(len(v)) if len(v) > 1 else None, 4)
        assert r["significant_blocked"] == bool(want["ci_low"] is not None and (want["ci_low"] > 0 or want["ci_high"] < 0))
    one = rows(spark, "pead_persistence").iloc[0]
    pooled = got.loc[[("POOLED", "raw", h) for h in C.horizons]].reset_index()
    hits = pooled[pooled["significant_blocked"]]["horizon_sessions"]
    assert one["last_significant_horizon"] == (hits.max() if len(hits) else 0) and one["n_significant"] == len(hits)
    assert list(one["horizons_tested"]) == list(C.horizons) and close(one["smallest_detectable_at_longest"], pooled["min_detectable_effect"].iloc[-1])
    six = rows(spark, "fig06_pead").set_index(CELL)
    assert set(six.index) == {k for k in got.index if k[2] > 0} and all(close(six.loc[k, "ci_low"], got.loc[k, "ci_low"]) for k in six.index)
    seven = rows(spark, "fig07_continuation").set_index(CELL)
    for key, v, _ in drift_cells(pead):
        n, up = len(v), int((v > 0).sum())
        r = seven.loc[key]
        assert (r["n_events"], r["n_continued"]) == (n, up)
        tail = lambda p, ks: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
        assert up == 0 and r["low"] == 0 or abs(tail(r["low"], range(up, n + 1)) - C.alpha / 2) < 1e-4
        assert up == n and r["high"] == 1 or abs(tail(r["high"], range(up + 1)) - C.alpha / 2) < 1e-4


@pytest.fixture(scope="module")
def closes(study):
    grid = frame(study.grid)
    return grid.pivot(index="pos", columns="symbol", values="close").astype(float), dict(zip(grid["session_date"], grid["pos"], strict=True))


def adjusted(closes, k):
    fwd = closes.shift(-k) / closes - 1
    return fwd.sub((fwd.sum(axis=1).to_numpy()[:, None] - fwd) / (fwd.shape[1] - 1))


def test_dc_placebo(spark, pead, closes):
    panel, place = closes
    got = rows(spark, "dc_placebo").set_index("horizon_sessions")
    r0 = adjusted(panel, 1).shift(1)
    moved = (panel / panel.shift(1)).notna()
    longest, rng = max(C.horizons), np.random.default_rng(C.seed)
    counts = pead["symbol"].value_counts()
    pools = {}
    for s in sorted(counts.index):
        busy = {p + d for day in pead[pead["symbol"] == s]["D0"] if (p := place.get(day)) is not None for d in range(-C.exclusion_radius, C.exclusion_radius + 1)}
        pools[s] = [p for p in range(1, len(panel) - longest) if p not in busy and moved[s][p] and np.isfinite(r0[s][p])]
    for k in C.horizons:
        signed = np.sign(r0) * adjusted(panel, k)
        draws = [np.nanmean(np.concatenate([signed[s].to_numpy()[rng.choice(pools[s], counts[s])] for s in pools if pools[s]])) for _ in range(C.placebo_iters)]
        observed = pead[f"signed_adj_drift_{k}d"].mean()
        low, high = np.nanpercentile(draws, [2.5, 97.5])
        r = got.loc[k]
        want = (observed, np.nanmean(draws), np.nanstd(draws, ddof=1), low, high, float(np.mean(np.abs(draws - np.nanmean(draws)) >= abs(observed - np.nanmean(draws)))))
        assert all(close(a, b) for a, b in zip(r[["observed_mean_drift", "placebo_mean", "placebo_sd", "placebo_low", "placebo_high", "p_value_vs_placebo"]], want, strict=True))
        assert r["outside_placebo_95"] == bool(observed < low or observed > high) and r["n_replications"] == C.placebo_iters


def test_dc_clean_peers(spark, pead, closes):
    panel, place = closes
    got = rows(spark, "dc_clean_peers").set_index("horizon_sessions")
    own = {s: [place[d] for d in pead[pead["symbol"] == s]["D0"] if d in place] for s in panel.columns}

    def clean(target, p, k):
        return [s for s in panel.columns if s != target and not any(p - C.peer_lookback <= x <= p + k for x in own[s])]

    first, rows_ = panel / panel.shift(1) - 1, []
    for ev in pead.itertuples():
        p = place.get(ev.D0, -1)
        if p < 1:
            continue
        rec = {"block_m": ev.block_m}
        if base := clean(ev.symbol, p, 0):
            sign = np.sign(first[ev.symbol][p] - first.loc[p, base].mean())
            for k in C.horizons:
                fwd, peers = panel.shift(-k) / panel - 1, clean(ev.symbol, p, k)
                rec[f"n{k}"] = len(peers)
                if peers:
                    rec[f"d{k}"] = sign * (fwd[ev.symbol][p] - fwd.loc[p, peers].mean())
        rows_.append(rec)
    made = pd.DataFrame(rows_)
    for k in C.horizons:
        kept, r = made.dropna(subset=[f"d{k}"]), got.loc[k]
        want = one_sample(kept[f"d{k}"], kept["block_m"])
        assert same(r, want, {"n": "n_events", "mean": "mean_drift", "median": "median_drift", "share_positive": "continuation_rate", "ci_low": "ci_low_blocked", "ci_high": "ci_high_blocked"})
        assert close(r["median_clean_peers"], made[f"n{k}"].median()) and r["events_dropped_no_clean_peer"] == len(pead) - want["n"]


def test_sens_threshold(spark):
    subjects = rows(spark, "agg_subject_summary")
    got = rows(spark, "sens_threshold")
    assert len(got) == len(C.sweep_returns) * len(C.sweep_volumes) and got["is_headline_setting"].sum() == 1
    for r in got.itertuples():
        base = subjects[f"baseline_abs_r_{M}"]
        ok = (base > 0) & (subjects[f"median_abs_adj_r_{M}"] >= r.return_multiple * base) & (subjects[f"median_vol_ratio_{M}"] >= r.volume_ratio) & (subjects[f"abs_r_{M}_ci_low"].astype(float) > base)
        names = sorted(subjects[ok]["subject"])
        assert r.n_subjects_strong == len(names) and r.subjects_strong == (", ".join(names) or "(none)")


def test_sens_window_has_the_rows_of_each_window_and_the_test(spark, events):
    got = rows(spark, "sens_window").set_index("cluster_window_hours")
    assert list(got.index) == list(C.sweep_hours)
    r, want = got.loc[C.cluster_hours], kruskal(events, f"abs_adj_r_{M}")
    assert r["n_events"] == len(events) and r["is_headline_setting"] and close(r["kw_epsilon_sq"], want[1], 4) and close(r["kw_p"], chi2_sf(want[0], want[3] - 1), 4)
    part = frame(q.QUERIES["sens_window_24h"](spark, SF)).iloc[0]
    assert all(close(part[c], got.reset_index().set_index("cluster_window_hours").loc[24, c]) for c in part.index if c not in ("cluster_window_hours",))
