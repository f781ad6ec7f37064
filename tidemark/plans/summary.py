"""Tables that summarise measured events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.functions import ols, ranks, resample

ALL_SUBJECTS = "ALL SUBJECTS"


def usable(events: DataFrame) -> DataFrame:
    return events.where("exclusion_reason = ''")


def windows(cfg: StudyConfig) -> list[str]:
    return [*(f"r_{k}m" for k in cfg.intraday_windows), "r_to_close", *(f"r_{h}d" for h in cfg.horizons)]


def subject_aggregates(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row a subject without what needs resampling."""
    m, first = cfg.main, cfg.intraday_windows[0]
    columns = [
        F.count("*").alias("n_events"), F.sum("n_filings").alias("n_filings"), F.count_distinct("symbol").alias("n_stocks"),
        ranks.share_of_all(F.col("tradable_regime") == "at_open").alias("share_tradable_at_open"), F.avg(F.col("overlap_60m").cast("double")).alias("share_overlapping_60m"),
    ]
    for c in windows(cfg):
        columns += [F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}"), F.avg(f"adj_{c}").alias(f"mean_adj_{c}"), F.median(f"adj_{c}").alias(f"median_adj_{c}"), ranks.share_of_all(F.col(f"adj_{c}") > 0).alias(f"share_positive_adj_{c}")]
    columns += [F.median(f"abs_adj_r_{m}").alias(f"median_abs_adj_r_{m}"), F.avg(f"abs_adj_r_{m}").alias(f"mean_abs_adj_r_{m}"), F.median(f"baseline_abs_r_{m}").alias(f"baseline_abs_r_{m}")]
    columns += [F.median(f"vol_ratio_{first}m").alias(f"median_vol_ratio_{first}m"), F.median(f"vol_ratio_{m}").alias(f"median_vol_ratio_{m}"), F.avg(f"vol_ratio_{m}").alias(f"mean_vol_ratio_{m}")]
    columns += [F.median("vol_ratio_d0").alias("median_vol_ratio_d0"), F.median(f"rv_ratio_{m}").alias(f"median_rv_ratio_{m}"), F.median(f"range_ratio_{m}").alias(f"median_range_ratio_{m}")]
    return usable(events).groupBy("subject").agg(*columns)


def strong_prongs(cfg: StudyConfig, returns: Column | float | None = None, volume: Column | float | None = None) -> dict[str, Column]:
    """The three conditions of strong impact, on columns of the subject summary."""
    m = cfg.main
    base, med = F.col(f"baseline_abs_r_{m}"), F.col(f"median_abs_adj_r_{m}")
    returns = cfg.strong_return if returns is None else returns
    volume = cfg.strong_volume if volume is None else volume
    size = F.coalesce((base > 0) & (med >= returns * base), F.lit(False))
    vol = F.coalesce(F.col(f"median_vol_ratio_{m}") >= volume, F.lit(False))
    evidence = F.coalesce(F.col(f"abs_r_{m}_ci_low") > base, F.lit(False))
    return {"strong_size": size, "strong_volume": vol, "strong_evidence": evidence, "strong_impact": size & vol & evidence}


def subject_summary(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row a subject, with blocked intervals and the verdict on strong impact; greatest response first."""
    m = cfg.main
    rows = usable(events).withColumn("block_d", resample.block_label(1))
    ci = resample.intervals(rows, ["subject"], f"abs_adj_r_{m}", "block_d", cfg.bootstrap_iters, cfg.seed).select(F.col("subject").alias("s1"), F.col("ci_low").alias(f"abs_r_{m}_ci_low"), F.col("ci_high").alias(f"abs_r_{m}_ci_high"))
    vol = resample.intervals(rows, ["subject"], f"vol_ratio_{m}", "block_d", cfg.bootstrap_iters, cfg.seed).select(F.col("subject").alias("s2"), F.col("ci_low").alias(f"vol_ratio_{m}_ci_low"), F.col("ci_high").alias(f"vol_ratio_{m}_ci_high"))
    out = subject_aggregates(events, cfg).join(ci, F.col("subject") == F.col("s1"), "left").join(vol, F.col("subject") == F.col("s2"), "left").drop("s1", "s2")
    out = out.withColumns({"return_multiple_of_baseline": F.try_divide(f"median_abs_adj_r_{m}", f"baseline_abs_r_{m}"), **strong_prongs(cfg), "inference_supported": F.col("n_events") >= cfg.min_events})
    return out.orderBy(F.desc_nulls_last(f"median_abs_adj_r_{m}"), "subject")


def stock_aggregates(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """By symbol and by symbol and subject in one pass, by grouping sets."""
    m = cfg.main
    rows = usable(events).rollup("symbol", "subject").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n_events"), F.median(f"abs_adj_r_{m}").alias(f"median_abs_adj_r_{m}"), F.avg(f"abs_adj_r_{m}").alias(f"mean_abs_adj_r_{m}"),
        F.median(f"adj_r_{m}").alias(f"median_adj_r_{m}"), ranks.share_of_all(F.col(f"adj_r_{m}") > 0).alias(f"share_positive_{m}"), F.median(f"vol_ratio_{m}").alias(f"median_vol_ratio_{m}"),
        F.median(f"rv_ratio_{m}").alias(f"median_rv_ratio_{m}"), F.median("adj_r_to_close").alias("median_adj_r_to_close"),
    )
    rows = rows.where("gid < 3").withColumn("subject", F.when(F.col("gid") == 1, F.lit(ALL_SUBJECTS)).otherwise(F.col("subject"))).drop("gid")
    return rows.withColumn("inference_supported", F.col("n_events") >= cfg.min_events)


def stock_summary(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    column = f"abs_adj_r_{cfg.main}"
    rows = usable(events).withColumn("block_d", resample.block_label(1))
    pooled = resample.intervals(rows.withColumn("subject", F.lit(ALL_SUBJECTS)), ["symbol", "subject"], column, "block_d", cfg.bootstrap_iters, cfg.seed)
    ci = pooled.unionByName(resample.intervals(rows, ["symbol", "subject"], column, "block_d", cfg.bootstrap_iters, cfg.seed)).drop("ci_low_naive", "ci_high_naive")
    return stock_aggregates(events, cfg).join(ci, ["symbol", "subject"], "left").orderBy("symbol", F.desc("n_events"), "subject")


#: Specifications of the robustness table, in order.
SPECIFICATIONS = ("all events", "no overlap", "winsorised 1/99")


def specified(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """(specification, kept, subject, abs_r, r, vol): every usable event under each specification, whether it is kept, and its
    size, signed return and volume ratio there, winsorised to the 1st and 99th percentiles over all events where it says so."""
    m = cfg.main
    columns = {"abs_r": f"abs_adj_r_{m}", "r": f"adj_r_{m}", "vol": f"vol_ratio_{m}"}
    rows = usable(events).select("subject", "overlap_60m", *[F.col(c).alias(k) for k, c in columns.items()])
    edges = rows.agg(*[F.percentile(k, q).alias(f"{k}_{e}") for k in columns for e, q in (("lo", 0.01), ("hi", 0.99))])

    def clipped(k: str) -> Column:
        return F.when(F.col(k).isNotNull(), F.greatest(F.least(k, f"{k}_hi"), f"{k}_lo")).alias(k)

    whole, clear, cut = SPECIFICATIONS
    specs = F.array(
        F.struct(F.lit(whole).alias("specification"), F.lit(True).alias("kept"), *columns),
        F.struct(F.lit(clear).alias("specification"), (~F.col("overlap_60m")).alias("kept"), *columns),
        F.struct(F.lit(cut).alias("specification"), F.lit(True).alias("kept"), *map(clipped, columns)),
    )
    return rows.join(F.broadcast(edges), F.lit(True)).select("subject", F.explode(specs).alias("s")).select("s.specification", "s.kept", "subject", *[f"s.{k}" for k in columns])


def robustness(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Medians of every subject under each specification, in one plan; a subject without a kept event has n = 0."""

    def median(k: str) -> Column:
        return F.median(F.when(F.col("kept"), F.col(k)))

    return specified(events, cfg).groupBy("specification", "subject").agg(F.count_if("kept").alias("n"), median("abs_r").alias("median_abs_r"), median("r").alias("median_r"), median("vol").alias("median_vol_ratio"))


def robustness_tests(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Kruskal-Wallis under the three specifications."""
    rows = specified(events, cfg).where("kept")
    found = [(s, *(t[k] for k in ("H", "p", "epsilon_sq", "n", "k"))) for s in SPECIFICATIONS for t in [ranks.kruskal_test(rows.where(F.col("specification") == s), "subject", "abs_r", cfg.min_events)]]
    return events.sparkSession.createDataFrame(found, "specification string, H double, p double, epsilon_sq double, n long, k long")


def subject_tests(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Whether subject is related to response: rank test, permutation test and regression."""
    m = cfg.main
    rows = usable(events).withColumns({"log_vol_ratio": F.ln(F.when(F.col(f"vol_ratio_{m}") > 0, F.col(f"vol_ratio_{m}"))), "block_m": resample.block_label(20)})
    out = []
    for label, c in ((f"absolute peer-adjusted {m} return", f"abs_adj_r_{m}"), (f"log volume ratio, {m}", "log_vol_ratio"), (f"realised volatility ratio, {m}", f"rv_ratio_{m}")):
        t = ranks.kruskal_test(rows, "subject", c, cfg.min_events)
        out.append((label, "Kruskal-Wallis across subjects", t["H"], t["p"], t["n"], t["k"], t["epsilon_sq"]))
        p = resample.permutation_test(rows, "subject", c, "symbol", cfg.permutation_iters, cfg.seed, cfg.min_events).first()
        out.append((label, "permutation, labels shuffled within stock", *((p.observed, p.p, p.n, p.k) if p else (None, None, 0, 0)), None))
    try:
        f = ols.clustered_ols(rows, f"abs_adj_r_{m}", "subject", "symbol", "block_m")
        out.append((f"absolute peer-adjusted {m} return", "OLS, subject dummies + stock FE, SE clustered by stock-month", f["F"], f["p"], f["n"], None, f["r_squared"]))
    except (ValueError, ArithmeticError, IndexError) as error:  # a singular design is a row of the report
        out.append((f"absolute peer-adjusted {m} return", f"OLS failed: {type(error).__name__}", None, None, None, None, None))
    return events.sparkSession.createDataFrame(out, "response_measure string, test string, statistic double, p_value double, n long, groups long, effect_size_epsilon_sq double")


def event_table(events: DataFrame, aligned: DataFrame, cfg: StudyConfig) -> DataFrame:
    """All events and, after them, the filings that were left out, each with its reason."""
    left_out = aligned.where("exclusion_reason <> ''").withColumnRenamed("NEWSID", "anchor_NEWSID").select("anchor_NEWSID", "symbol", "event_ts", "ts_source", "subject", "subject_rule", "exclusion_reason")
    both = events.unionByName(left_out, allowMissingColumns=True)
    m = cfg.main
    order = ["cluster_id", "symbol", "subject", "anchor_NEWSID", "event_ts", "effective_ts", "D0", "arrival_bucket", "tradable_regime", "n_filings", "n_companion_filings", "member_subjects", "exclusion_reason", *windows(cfg), *(f"adj_{c}" for c in windows(cfg)), f"vol_ratio_{m}", f"rv_ratio_{m}", f"range_ratio_{m}", "vol_ratio_d0", "overlap_60m", "overlap_same_session"]
    return both.select(*order).orderBy(F.asc_nulls_last("effective_ts"), F.asc_nulls_last("symbol"), "anchor_NEWSID")
