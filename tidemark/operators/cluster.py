"""Clustering of related filings into independent events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from tidemark.config import StudyConfig

_ORDER = ("effective_ts", "event_ts", "NEWSID")


def anchor_clusters(rows: DataFrame, hours: int, into: str = "cluster_id") -> DataFrame:
    """Clusters of one symbol and subject: a filing more than ``hours`` after its cluster's first opens the next.

    The rule is a fold along time, so rows are sorted by symbol, subject and time within partitions and pass one by one; a task
    holds one batch and the anchor that is open, however long a run of filings is.
    """
    span = hours * 3_600_000_000
    sorted_rows = rows.repartition("symbol", "subject").sortWithinPartitions("symbol", "subject", *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, 0
        for batch in batches:
            columns = {f.name: k for k, f in enumerate(batch.schema)}
            who = zip(batch.column(columns["symbol"]).to_pylist(), batch.column(columns["subject"]).to_pylist(), strict=True)
            at = batch.column(columns["effective_ts"]).cast(pa.int64()).to_pylist()
            anchors = []
            for k, t in zip(who, at, strict=True):
                if k != key or t - anchor > span:
                    key, anchor = k, t
                anchors.append(anchor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anchors, pa.timestamp("us"))], names=[*batch.schema.names, "anchor__"])

    folded = sorted_rows.mapInArrow(run, StructType([*sorted_rows.schema.fields, StructField("anchor__", TimestampNTZType())]))
    return folded.withColumn(into, F.concat_ws("|", "symbol", "subject", F.date_format("anchor__", "yyyy-MM-dd HH:mm:ss"))).drop("anchor__")


def merge_fiscal(rows: DataFrame) -> DataFrame:
    """One cluster for each symbol and fiscal period; filings without one follow the least period of their cluster."""
    period = F.coalesce("fiscal_period", F.min("fiscal_period").over(Window.partitionBy("cluster_id")))
    return rows.withColumn("cluster_id", F.when(period.isNotNull(), F.concat("symbol", F.lit("-FP-"), period)).otherwise(F.col("cluster_id")))


def nearest_cluster(companions: DataFrame, clusters: DataFrame, hours: int) -> DataFrame:
    """(NEWSID, cluster_id): the cluster of the symbol whose anchor is nearest within ``hours``; ties go to the later anchor.

    Anchors are joined by time bucket and its two neighbours, never all with all.
    """
    bucket = F.floor(F.unix_timestamp(F.col("effective_ts").cast("timestamp")) / F.lit(hours * 3600))
    left = companions.select("NEWSID", "symbol", "effective_ts", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    right = clusters.select(F.col("symbol").alias("s2"), F.col("cluster_id").alias("cid"), "anchor", F.floor(F.unix_timestamp(F.col("anchor").cast("timestamp")) / F.lit(hours * 3600)).alias("b2"))
    gap = F.abs(F.expr("timestampdiff(MICROSECOND, effective_ts, anchor)"))
    pairs = left.join(right, (F.col("symbol") == F.col("s2")) & (F.col("b") == F.col("b2"))).withColumn("gap", gap).where(F.col("gap") <= hours * 3_600_000_000)
    best = F.max_by("cid", F.struct(-F.col("gap"), "anchor", "cid"))
    return pairs.groupBy("NEWSID").agg(best.alias("cluster_id"))


def build_clusters(aligned: DataFrame, cfg: StudyConfig, hours: int | None = None) -> DataFrame:
    """Usable filings with their cluster."""
    hours = hours or cfg.cluster_hours
    rows = aligned.where("exclusion_reason = ''")
    main = merge_fiscal(anchor_clusters(rows.where("not is_companion"), hours))
    clusters = main.groupBy("symbol", "cluster_id").agg(F.min("effective_ts").alias("anchor"))
    companions = rows.where("is_companion")
    near = nearest_cluster(companions, clusters, hours).select(F.col("NEWSID").alias("n2"), F.col("cluster_id"))
    joined = companions.join(near, F.col("NEWSID") == F.col("n2"), "left").drop("n2")
    orphans = anchor_clusters(joined.where("cluster_id is null").drop("cluster_id"), hours)
    return main.unionByName(joined.where("cluster_id is not null")).unionByName(orphans)


def collapse(clustered: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One event for each cluster: its earliest filing's alignment, named by its filing of highest priority."""
    name_order = F.struct(F.col("subject_priority"), *[F.col(c) for c in _ORDER])
    named = F.when(~F.col("is_companion"), name_order) if cfg.namer == "substantive" else name_order
    name = F.struct("subject", "subject_rule", "subject_priority", "is_companion", "fiscal_period")
    first = F.struct(*[c for c in clustered.columns if c not in ("cluster_id", "subject", "subject_rule", "subject_priority", "is_companion", "fiscal_period")])
    micros = F.expr("timestampdiff(MICROSECOND, min(effective_ts), max(effective_ts))")
    rows = clustered.groupBy("cluster_id").agg(
        F.min_by(first, F.struct(*_ORDER)).alias("f"),
        F.coalesce(F.min_by(name, named), F.min_by(name, name_order)).alias("n"),
        F.count("*").alias("n_filings"),
        F.count_if(F.col("is_companion")).alias("n_companion_filings"),
        F.array_join(F.array_sort(F.collect_set("subject")), " | ").alias("member_subjects"),
        (micros / F.lit(3.6e9)).alias("cluster_span_hours"),
    )
    return overlaps(rows.select("cluster_id", "f.*", "n.*", "n_filings", "n_companion_filings", "member_subjects", "cluster_span_hours").withColumnRenamed("NEWSID", "anchor_NEWSID"))


def overlaps(events: DataFrame) -> DataFrame:
    """Flag events with another of the symbol within an hour, or in the same session."""
    within = F.expr("count(*) over (partition by symbol order by effective_ts range between interval 60 minutes preceding and interval 60 minutes following) > 1")
    return events.withColumns({"overlap_60m": within, "overlap_same_session": F.count("*").over(Window.partitionBy("symbol", "D0")) > 1})
