"""The study's entities built from the driver's tables; see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.taxonomy import subject_table
from tidemark.sources import bars as bar_source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by event type and hour."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = events.groupBy("symbol", hour.alias("bar_ts")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("volume"),
    )
    return bar_source.derive(rows.withColumnRenamed("bar_ts", "ts"), 60)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified announcements: every event is one, its subject by user, months as fiscal periods of every second result."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("NEWSID"), F.col("event_type").alias("symbol"), F.col("ts").alias("event_ts"), F.lit("DissemDT").alias("ts_source"), (F.col("user_id") % 12 + 1).cast("int").alias("subject_priority"))
    rows = rows.join(F.broadcast(subject_table(spark)), "subject_priority")
    period = F.when((F.col("subject") == "Financial Results") & (F.col("NEWSID") % 2 == 0), F.concat(F.date_format("event_ts", "yyyy-MM"), F.lit("-01")))
    return rows.select("NEWSID", "symbol", "event_ts", "ts_source", "subject", F.lit("fixture").alias("subject_rule"), "subject_priority", "is_companion", period.alias("fiscal_period"))


def session_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing prices by market segment and order date: the price of the date's last order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("symbol"), F.col("o_orderdate").cast("date").alias("session_date"))
    return rows.agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))
