"""The data behind the study's figures; nothing is drawn here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.functions import tails
from tidemark.plans.summary import usable

DELAY_BINS = 40


def fig01_arrival(aligned: DataFrame) -> DataFrame:
    """Filings by arrival and symbol."""
    return aligned.where("exclusion_reason = ''").groupBy("symbol", "arrival_bucket").agg(F.count("*").alias("n_filings"))


def fig01_delays(aligned: DataFrame, most: float) -> DataFrame:
    """A histogram of the minutes from filing to the first tradable bar, up to ``most``."""
    rows = aligned.where((F.col("exclusion_reason") == "") & (F.col("delay_minutes") <= most))
    return rows.groupBy(F.least(F.floor(F.col("delay_minutes") / (most / DELAY_BINS)), F.lit(DELAY_BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n_filings"))


def fig02_clustering(events: DataFrame) -> DataFrame:
    """Filings an event by subject."""
    return usable(events).groupBy("subject").agg(F.count("*").alias("n_events"), F.sum("n_filings").alias("n_filings"), (F.sum("n_filings") / F.count("*")).alias("filings_per_event"))


def fig03_subject_return(summary: DataFrame, cfg: StudyConfig) -> DataFrame:
    m = cfg.main
    return summary.select("subject", "n_events", f"median_abs_adj_r_{m}", f"abs_r_{m}_ci_low", f"abs_r_{m}_ci_high", f"baseline_abs_r_{m}")


def fig04_subject_volume(summary: DataFrame, cfg: StudyConfig) -> DataFrame:
    m = cfg.main
    return summary.select("subject", "n_events", f"median_vol_ratio_{m}", f"vol_ratio_{m}_ci_low", f"vol_ratio_{m}_ci_high")


def fig05_response_decay(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Median absolute adjusted return by subject and window."""
    names = [*(f"r_{k}m" for k in cfg.intraday_windows), "r_to_close"]
    cells = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"abs_adj_{n}").alias("v")) for n in names])
    return usable(events).select("subject", F.explode(cells).alias("c")).groupBy("subject", F.col("c.window").alias("window")).agg(F.median("c.v").alias("median_abs_adj"))


def fig06_pead(summary: DataFrame) -> DataFrame:
    return summary.where("horizon_sessions > 0").select("scope", "measure", "horizon_sessions", "mean_drift", "ci_low", "ci_high", "n_events")


def fig07_continuation(aggregates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Shares of events whose drift went on, with exact limits, a row a cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            limits = [tails.clopper_pearson(int(k), int(n), alpha) for k, n in zip(pdf["n_continued"], pdf["n_events"], strict=True)]
            yield pdf.assign(low=[x for x, _ in limits], high=[x for _, x in limits])

    rows = aggregates.where("horizon_sessions > 0 and n_events > 0").select("scope", "measure", "horizon_sessions", "n_continued", "n_events", "continuation_rate")
    return rows.mapInPandas(run, "scope string, measure string, horizon_sessions int, n_continued long, n_events long, continuation_rate double, low double, high double")


def fig08_heatmap(events: DataFrame, cfg: StudyConfig, symbols: list[str]) -> DataFrame:
    """Median absolute adjusted return, a row a subject and a column a symbol."""
    return usable(events).groupBy("subject").pivot("symbol", symbols).agg(F.median(f"abs_adj_r_{cfg.main}"))
