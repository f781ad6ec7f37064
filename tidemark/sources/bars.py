"""Intraday bars: CSV scans, a partitioned Parquet cache, and the close grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV_SCHEMA = "date timestamp_ntz, open double, high double, low double, close double, volume double"
PRICES = ("open", "high", "low", "close")


def _present(name: str) -> Column:
    """A double with NaN as null: no NaN may enter a plan."""
    return F.when(~F.isnan(name), F.col(name)).alias(name)


def derive(bars: DataFrame, bar_minutes: int = 1) -> DataFrame:
    """Add session_date, minute_of_day and bar_end."""
    return bars.select(
        "symbol", "ts", *PRICES, F.col("volume").cast("double").alias("volume"),
        F.col("ts").cast("date").alias("session_date"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(bar_minutes))).alias("bar_end"),
    )


def read_raw_csv(spark: SparkSession, folder: str, symbols: list[str]) -> DataFrame:
    """All rows of ``<SYMBOL>.csv``, a file or a folder of parts, as they stand, with the symbol from that name."""
    rows = spark.read.schema(CSV_SCHEMA).option("header", True).csv([f"{folder}/{s}.csv" for s in symbols])
    symbol = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(?:/[^/]*)?$", 1)
    return rows.select(symbol.alias("symbol"), F.col("date").alias("ts"), *map(_present, (*PRICES, "volume")), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def first_of_each(rows: DataFrame) -> DataFrame:
    """One bar for each symbol and time, the first of the file."""
    w = Window.partitionBy("symbol", "ts").orderBy("block", "line")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "block", "line")


def read_bars(spark: SparkSession, folder: str, symbols: list[str], bar_minutes: int = 1) -> DataFrame:
    return derive(first_of_each(read_raw_csv(spark, folder, symbols)), bar_minutes)


def cached_bars(bars: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """Bars from the cache at ``path``, written first if it isn't there or on ``refresh``; partitioned so that a symbol prunes
    files. A cache is not compared with its source: after a change of that, refresh it."""
    spark = bars.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if refresh or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        bars.write.mode("overwrite").partitionBy("symbol").parquet(path)
    return spark.read.parquet(path).select(*bars.columns)


def close_grid(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Closes on the union of all times, a column a symbol, each filled forward.

    Closes are carried along one day at a time; what a day starts with comes from a table with one row a day.
    """
    grid = bars.groupBy("ts").pivot("symbol", symbols).agg(F.max("close")).withColumn("day__", F.col("ts").cast("date"))
    days = grid.groupBy(F.col("day__").alias("d__")).agg(*[F.max_by(s, F.when(F.col(s).isNotNull(), F.col("ts"))).alias(s) for s in symbols])
    before = Window.orderBy("d__").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select("d__", *[F.last(s, ignorenulls=True).over(before).alias(f"{s}__") for s in symbols])
    within = Window.partitionBy("day__").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    carried = grid.select("ts", "day__", *[F.last(s, ignorenulls=True).over(within).alias(s) for s in symbols])
    return carried.join(days, F.col("day__") == F.col("d__")).select("ts", *[F.coalesce(s, f"{s}__").alias(s) for s in symbols])
