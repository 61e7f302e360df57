"""Rules that no SQL over the views shows: names that are claimed, requests that are refused, golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import text
from shutterlake.operators import predicates, query, sequence
from shutterlake.plans import catalog_queries


def claimed(spark, names, folder="f"):
    df = spark.createDataFrame([(i, folder, n, "jpg") for i, n in enumerate(names)], "id int, folder string, name string, ext string")
    return [r["claimed"] for r in sorted(text.claim_names(df, "folder", "name", "ext", [F.col("id")]).collect(), key=lambda r: r["id"])]


def test_claimed_names_are_free(spark):
    assert claimed(spark, ["a", "A", "a"]) == ["a.jpg", "A-2.jpg", "a-3.jpg"]
    assert claimed(spark, ["a", "a", "a-2"]) == ["a.jpg", "a-2.jpg", "a-2-2.jpg"]
    assert claimed(spark, ["a-2", "a", "a", "b"]) == ["a-2.jpg", "a.jpg", "a-3.jpg", "b.jpg"]


@pytest.mark.parametrize(("template", "want"), [("..{filename}", "x"), ("{camera}", "x"), (" {id}", "7"), ("{filename}" + "é" * 200, "x" + "é" * 119)])
def test_templates(spark, template, want):
    columns = {"filename": F.lit("x"), "camera": F.lit(None).cast("string"), "id": F.lit(7)}
    assert spark.range(1).select(text.expand(template, columns).alias("n")).first()["n"] == want


def frames(spark, rows):
    return spark.createDataFrame(rows, "id int, folder int, t long, hash long, overall double")


@pytest.mark.parametrize(("rows", "want"), [
    ([(1, 0, 0, 0, 0.5), (2, 0, 1000, 0, 0.9), (3, 0, 5000, 0, 0.4)], {1: False, 2: True}),  # a gap ends a chain; chains of one go
    ([(1, 0, 0, 0, 0.5), (2, 0, 1400, 0, 0.5), (3, 0, 2800, 0, 0.5)], {1: True, 2: False, 3: False}),  # each is near the last; the earliest on a tie
    ([(1, 0, 0, 0, 0.5), (2, 0, 100, (1 << 13) - 1, 0.9)], {}),  # thirteen bits part them
    ([(1, 0, 0, 0, 0.5), (2, 1, 100, 0, 0.9)], {}),  # two folders
    ([(1, 0, None, 0, 0.5), (2, 0, None, 0, 0.9)], {}),  # no time
])
def test_bursts(spark, rows, want):
    from pyspark.sql import Window

    w = Window.partitionBy("folder").orderBy("t", "id")
    unlike = F.coalesce(F.bit_count(F.col("hash").bitwiseXOR(F.lag("hash").over(w))) > 12, F.lit(False))
    got = sequence.bursts(frames(spark, rows), "folder", "t", "id", "overall", 1500, unlike).collect()
    assert {r["id"]: r["is_keeper"] for r in got} == want


def test_nearest_without_keys_crosses_buckets(spark):
    anchors = spark.createDataFrame([(1, 0), (2, 10_000_000), (3, 10_000_000), (4, 90_000_000)], "id long, t long")
    targets = spark.createDataFrame([(9, 4_000_000), (8, 5_000_000), (7, 49_000_000), (6, 10_000_000), (5, 99_999_999_999)], "id long, t long")
    got = {r["id"]: (r["nearest"], r["gap_ms"]) for r in sequence.nearest(targets, anchors, [], "t", "id").collect()}
    assert got == {9: (1, 4_000_000), 8: (1, 5_000_000), 7: (2, 39_000_000), 6: (2, 0), 5: (4, 99_909_999_999)}


def test_nearest_of_a_key_is_dealt_out_and_reads_no_row_again(spark):
    rng = random.Random(4)
    when = lambda k: rng.randrange(0, 30 * 3_600_000, 500) if k % 3 else rng.randrange(0, 9) * 3_600_000
    anchors = [(i, rng.choice([1, 1, 2, 5]), when(i)) for i in range(400)]
    targets = [(1000 + i, rng.choice([1, 2, 3, None]), when(i)) for i in range(600)]
    a, t = (spark.createDataFrame(rows, "id long, k long, t long") for rows in (anchors, targets))
    found = sequence.nearest(t, a, ["k"], "t", "id")
    want = {}
    for i, k, at in targets:
        if own := [(abs(x - at), x, j) for j, q, x in anchors if q == k]:
            want[i] = (min(own)[2], min(own)[0])
    assert {r["id"]: (r["nearest"], r["gap_ms"]) for r in found.collect()} == want
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found.filter("k = 1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_requests_that_are_refused(spark, sf):
    tab = catalog_queries.tables(spark, sf)
    for bad in ({"min_rating": 6}, {"iso": (float("nan"), None)}, {"keeper_rule": "best"}, {"suggested": ["stars"]}):
        with pytest.raises(predicates.InvalidArgument):
            query.filtered(tab, query.CatalogQuery(**bad))
    for bad in ({"limit": 1001}, {"limit": 0}, {"offset": -1}, {"sort": "size"}):
        with pytest.raises(predicates.InvalidArgument):
            query.page_ids(tab, query.CatalogQuery(**bad))
    with pytest.raises(predicates.NotFound):
        query.by_ids(tab, [1, 999_999_999], strict=True)


def test_collapsed_bursts_stay_hidden_without_their_keeper(spark):
    images = spark.createDataFrame([(1, 7, "pick"), (2, 7, "unflagged"), (3, 7, "unflagged"), (4, None, "unflagged"), (5, 8, "unflagged")], "id int, burst_id int, pick string")
    bursts = spark.createDataFrame([(7, 1), (8, None)], "id int, keeper_id int")
    left = predicates.collapse_bursts(images.filter("pick = 'unflagged'"), bursts)
    assert sorted(r["id"] for r in left.collect()) == [4, 5]
