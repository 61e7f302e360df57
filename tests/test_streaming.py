"""Draining a queue of files is idempotent, and the newest row wins."""

import duckdb
from pyspark.sql import functions as F

from shutterlake.streaming import drain

SCHEMA = "id long, changed long, value string"


def test_drain_is_idempotent_and_newest_wins(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    take = lambda: drain.drain(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/state", files=1)
    put([(1, 10, "a"), (2, 10, "b")])
    put([(1, 5, "old"), (3, 1, "c")])
    take()
    take()
    put([(2, 10, "later"), (3, None, "none")])
    take()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    assert sorted(map(tuple, drain.current(spark, f"{tmp_path}/out", "id", "changed").collect())) == [(1, 10, "a"), (2, 10, "later"), (3, 1, "c")]


def test_sessions_against_sql(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain.session_counts(events, "user_id", "ts", "6 hours", "1 day").select("user_id", "n").collect()
    want = duckdb.sql(f"""WITH c AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS cut FROM '{sf}/events.parquet' WHERE ts IS NOT NULL),
        s AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM c) SELECT user_id, count(*) FROM s GROUP BY user_id, s""").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
