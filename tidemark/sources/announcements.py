"""The announcement feed: JSON lines with up to three clocks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "NEWSID string, SCRIP_CD long, NEWSSUB string, HEADLINE string, CATEGORYNAME string, SUBCATNAME string, DissemDT string, DT_TM string, NEWS_DT string, News_submission_dt string"

#: Clocks in order of preference.
CLOCKS = ("DissemDT", "DT_TM", "NEWS_DT")


def timestamp(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` as timestamp_ntz)").alias(name)


def prepare(raw: DataFrame, scrip_codes: Mapping[int, str]) -> DataFrame:
    """Parsed clocks, symbol, event_ts and the clock that it came from."""
    texts = ("NEWSSUB", "HEADLINE", "CATEGORYNAME", "SUBCATNAME")
    rows = raw.select("NEWSID", "SCRIP_CD", *[F.trim(c).alias(c) for c in texts], *[timestamp(c) for c in (*CLOCKS, "News_submission_dt")])
    codes = F.create_map(*[x for code, s in scrip_codes.items() for x in (F.lit(code), F.lit(s))])
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in CLOCKS], F.lit("none"))
    return rows.withColumns({"symbol": F.try_element_at(codes, F.col("SCRIP_CD").cast("int")), "event_ts": F.coalesce(*CLOCKS), "ts_source": source})


def read_announcements(spark: SparkSession, path: str, scrip_codes: Mapping[int, str]) -> DataFrame:
    return prepare(spark.read.schema(SCHEMA).json(path), scrip_codes)


def unique(announcements: DataFrame) -> DataFrame:
    """One row for each NEWSID, the earliest; repeated ids would fan out in joins."""
    rows = F.struct(F.col("event_ts"), *[c for c in announcements.columns if c not in ("event_ts", "NEWSID")])
    return announcements.groupBy("NEWSID").agg(F.min(rows).alias("r")).select(*[F.col("NEWSID") if c == "NEWSID" else F.col(f"r.{c}").alias(c) for c in announcements.columns])
