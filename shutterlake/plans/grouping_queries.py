"""Grouping operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.operators import sequence
from shutterlake.plans.catalog import register
from shutterlake.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ms.alias("t"))


@register(
    "grp01_bursts",
    """
    WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
    f AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 21600000000
                          OR event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS s
          FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS burst_no FROM f),
    h AS (SELECT *, count(*) OVER (PARTITION BY user_id, burst_no) AS burst_size,
                 row_number() OVER (PARTITION BY user_id, burst_no ORDER BY t, event_id) AS burst_pos,
                 row_number() OVER (PARTITION BY user_id, burst_no ORDER BY value DESC NULLS LAST, t, event_id) AS r FROM g)
    SELECT event_id, user_id, CAST(burst_no AS BIGINT) AS burst_no, burst_size, burst_pos, r = 1 AS is_keeper FROM h WHERE burst_size > 1
    """,
)
def grp01_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    cut = F.col("event_type") != F.lag("event_type").over(w)
    out = sequence.bursts(e, "user_id", "t", "event_id", "value", 21_600_000_000, cut)
    return out.select("event_id", "user_id", "burst_no", "burst_size", "burst_pos", "is_keeper")
