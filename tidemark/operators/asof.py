"""As-of joins without a native operator.

The time axis is cut into buckets. Within (key, bucket), events and bars are united and the nearest bar is carried along the
sorted bucket by a window; for events without one, the nearest bar of the closest bucket that has bars is taken from a table
with one row a bucket. So no task sorts more than one key's bucket, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, payload: list[str], direction: str, into: str, bucket: str = "DAY") -> DataFrame:
    """``left`` with a struct column ``into`` of the ``payload`` of the nearest row of ``right``, or null.

    backward: the last with right_time <= left_time; forward: the first with right_time >= left_time. Rows with a null
    key or time match nothing. Of equal times in ``right``, the greatest (backward) or least (forward) payload is taken.
    """
    back = direction == "backward"
    if not back and direction != "forward":
        raise ValueError(direction)

    def cut(time: str) -> Column:
        return F.date_trunc(bucket, F.col(time)).cast("timestamp_ntz")

    hit = F.struct(F.col(right_time).alias("at__"), *payload)
    rights = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("k__"), cut(right_time).alias("b__"), F.col(right_time).alias("t__"), hit.alias("hit__"))
    best = F.max("hit__") if back else F.min("hit__")
    carried = rights.groupBy("k__", "b__").agg(best.alias("edge__"))
    buckets = left.select(F.col(key).alias("k__"), cut(left_time).alias("b__")).distinct().unionByName(carried, allowMissingColumns=True)
    buckets = buckets.groupBy("k__", "b__").agg(F.max("edge__").alias("edge__"))
    w = Window.partitionBy("k__").orderBy("b__")
    beyond = F.last("edge__", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if back else F.last("edge__", ignorenulls=True).over(Window.partitionBy("k__").orderBy(F.desc("b__")).rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select("k__", "b__", beyond.alias("beyond__"))
    # rows of the right side sort before events of the same time, in either direction
    lefts = left.select(F.struct(*left.columns).alias("row__"), F.col(key).alias("k__"), cut(left_time).alias("b__"), F.col(left_time).alias("t__"), F.lit(1).alias("side__"))
    both = lefts.unionByName(rights.withColumn("side__", F.lit(0)), allowMissingColumns=True)
    order = [F.asc("t__"), F.asc("side__"), F.asc("hit__")] if back else [F.desc("t__"), F.asc("side__"), F.desc("hit__")]
    near = F.last("hit__", ignorenulls=True).over(Window.partitionBy("k__", "b__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("near__", near).where("side__ = 1").select("row__", "near__", "k__", "b__")
    joined = found.join(buckets.select(F.col("k__").alias("k2__"), F.col("b__").alias("b2__"), "beyond__"), (F.col("k__") == F.col("k2__")) & (F.col("b__") == F.col("b2__")), "left")
    nearest = F.when(F.col("k__").isNotNull() & F.col("b__").isNotNull(), F.coalesce("near__", "beyond__"))
    picked = F.when(nearest.isNotNull(), F.struct(*[nearest[c].alias(c) for c in payload]))
    return joined.select("row__.*", picked.alias(into))
