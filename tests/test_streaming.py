from pyspark.sql import functions as F

from tidemark.sources import fixtures as fx
from tidemark.streaming.bars import stream_bars

SF = "/root/testdata/sf0.001"


def test_streamed_bars_equal_the_batch(spark):
    batch = fx.table(spark, SF, "events")
    ticks = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF).select(F.col("event_type").alias("symbol"), "ts", "value")
    stream_bars(ticks).writeStream.format("memory").queryName("streamed_bars").outputMode("complete").start().processAllAvailable()
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("streamed_bars").collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in fx.hourly_bars(spark, SF).collect()}
    assert got == want
    for q in spark.streams.active:
        q.stop()
