"""Order-aware operators that window functions can express: gaps, sessions, ranks, clusters on a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the buckets of time in which nearest() meets rows.
BUCKET_MS = 3_600_000


def sessionize(df: DataFrame, keys: list[str], order: list[Column], boundary: Column, name: str = "session_no") -> DataFrame:
    """Number the chains of each key: a row whose boundary is true (it may use lag over the same window) starts one.

    The first row of a key always starts a chain. Null boundaries count as false. Shuffles once, on the keys.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    flag = F.when(first | F.coalesce(boundary, F.lit(False)), 1).otherwise(0)
    return df.withColumn("__start", flag).withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def bursts(df: DataFrame, key: str, time: str, row_id: str, score: str, max_gap: int, breaks: Column | None = None) -> DataFrame:
    """Chains of rows at most max_gap apart, per key; chains of one are dropped and rows without a time left out.

    breaks: true where a row can't follow the row before it, besides the gap. Each row gets burst_no, burst_size,
    burst_pos and is_keeper; the keeper has the largest score (none counts as smallest), the earliest row on a tie.
    """
    w = Window.partitionBy(key).orderBy(time, row_id)
    gap = F.col(time) - F.lag(time).over(w) > max_gap
    cut = gap if breaks is None else gap | breaks
    chained = sessionize(df.filter(F.col(time).isNotNull()), [key], [F.col(time), F.col(row_id)], cut, "burst_no")
    group = Window.partitionBy(key, "burst_no")
    best = group.orderBy(F.col(score).desc_nulls_last(), F.col(time), F.col(row_id))
    return (
        chained.withColumn("burst_size", F.count(F.lit(1)).over(group))
        .filter("burst_size > 1")
        .withColumn("burst_pos", F.row_number().over(group.orderBy(time, row_id)))
        .withColumn("is_keeper", F.row_number().over(best) == 1)
    )


def nearest(targets: DataFrame, anchors: DataFrame, keys: list[str], time: str, row_id: str) -> DataFrame:
    """Each target with the anchor of its keys that is nearest in time, as nearest and gap_ms; the earlier on a tie.

    Anchors are reduced to one row per time. Both sides are dealt to buckets of time, and each bucket carries the last
    anchor of its keys before it and the first one after it, so no task holds all rows of a key. What follows is taken as
    what precedes in falling order: a frame that ends unbounded would be read again for each row.
    """
    bucket, anchor = F.floor(F.col(time) / BUCKET_MS), F.struct(F.col(time).cast("long").alias(time), F.col("__a").cast("long").alias("__a"))
    at = anchors.groupBy(*keys, time).agg(F.min(row_id).alias("__a"))  # of anchors at one time the smallest id counts
    at = at.withColumn("__b", bucket).withColumn("__x", anchor)
    targets = targets.withColumn("__b", bucket)
    dealt = [*keys, "__b"]
    marks = at.select(*dealt, "__x").unionByName(targets.select(*dealt).distinct(), allowMissingColumns=True)
    ends = marks.groupBy(*dealt).agg(F.min("__x").alias("first"), F.max("__x").alias("last"))  # a row for each hour of a key

    def before(order: Column, value: str, keys: list[str], frame) -> Column:
        return F.last(value, True).over(frame(Window.partitionBy(*keys).orderBy(order)))

    others = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    around = ends.select(*dealt, F.array(before(F.asc("__b"), "last", keys, others), before(F.desc("__b"), "first", keys, others)).alias("x"))
    carried = around.select(*dealt, F.explode("x").alias("__x")).filter("__x IS NOT NULL").withColumn(time, F.col(f"__x.{time}"))
    both = targets.unionByName(at.drop("__a").unionByName(carried), allowMissingColumns=True)
    both = both.withColumn("__p", before(F.asc(time), "__x", dealt, upto)).withColumn("__n", before(F.desc(time), "__x", dealt, upto))
    back, ahead = F.col(time) - F.col(f"__p.{time}"), F.col(f"__n.{time}") - F.col(time)
    earlier = ahead.isNull() | (back <= ahead)
    out = both.filter(F.col(row_id).isNotNull() & (F.col("__p").isNotNull() | F.col("__n").isNotNull()))
    return out.withColumn("nearest", F.when(earlier, F.col("__p.__a")).otherwise(F.col("__n.__a"))).withColumn("gap_ms", F.when(earlier, back).otherwise(ahead))
