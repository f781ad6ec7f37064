"""Sweeps of the clustering window and of the thresholds of strong impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.functions import ranks
from tidemark.operators import cluster, impact
from tidemark.plans.summary import strong_prongs, usable
from tidemark.sources import scratch


def window_sweep(aligned: DataFrame, bars: DataFrame, sess: DataFrame, cfg: StudyConfig, hours: tuple[int, ...] | None = None, tests: bool = True) -> DataFrame:
    """Events rebuilt and measured anew for each clustering window, a row a window."""
    m, out = cfg.main, []
    for h in hours or cfg.sweep_hours:
        rebuilt = scratch.written(cluster.collapse(scratch.written(cluster.build_clusters(aligned, cfg, h), "sweep-clusters"), cfg), "sweep-events")
        events = scratch.written(usable(impact.measure(rebuilt, bars, sess, cfg)), "sweep-measured")

        def of(subject: str, column: str):
            return F.median(F.when(F.col("subject") == subject, F.col(column)))

        order_win = F.col("subject") == "Order Win"
        row = events.agg(
            F.count("*").alias("n_events"), (F.sum("n_filings") / F.count("*")).alias("filings_per_event"), F.count_if(F.col("subject") == "Financial Results").alias("n_earnings_events"),
            of("Financial Results", f"abs_adj_r_{m}").alias("median_abs_r_results"), of("Financial Results", f"vol_ratio_{m}").alias("median_vol_ratio_results"),
            of("Order Win", f"abs_adj_r_{m}").alias("median_abs_r_orderwin"), of("Routine Filing", f"abs_adj_r_{m}").alias("median_abs_r_routine"),
            F.avg(F.when(order_win, F.when(F.col(f"adj_r_{m}") > 0, 1.0).otherwise(0.0))).alias("orderwin_share_positive"),
        )
        row = row.select(F.lit(h).alias("cluster_window_hours"), "*", F.lit(h == cfg.cluster_hours).alias("is_headline_setting"))
        if tests:
            t = ranks.kruskal_test(events, "subject", f"abs_adj_r_{m}", cfg.min_events)
            row = row.withColumns({"kw_p": F.lit(t["p"]).cast("double"), "kw_epsilon_sq": F.lit(t["epsilon_sq"]).cast("double")})
        out.append(row)
    return reduce(DataFrame.unionByName, out)


def threshold_sweep(summary: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Which subjects are strong at each pair of thresholds; the grid is two short lists of settings."""
    spark = summary.sparkSession
    grid = spark.createDataFrame([(float(r), float(v)) for r in cfg.sweep_returns for v in cfg.sweep_volumes], "return_multiple double, volume_ratio double")
    cells = summary.withColumn("g", F.explode(F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(float(v)).alias("v")) for r in cfg.sweep_returns for v in cfg.sweep_volumes])))
    passing = cells.where(strong_prongs(cfg, F.col("g.r"), F.col("g.v"))["strong_impact"]).groupBy(F.col("g.r").alias("r"), F.col("g.v").alias("v")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("subject")), ", ").alias("names"))
    out = grid.join(passing, (F.col("return_multiple") == F.col("r")) & (F.col("volume_ratio") == F.col("v")), "left")
    headline = (F.col("return_multiple") == cfg.strong_return) & (F.col("volume_ratio") == cfg.strong_volume)
    return out.select("return_multiple", "volume_ratio", F.coalesce("n", F.lit(0)).cast("long").alias("n_subjects_strong"), F.coalesce("names", F.lit("(none)")).alias("subjects_strong"), headline.alias("is_headline_setting"))
