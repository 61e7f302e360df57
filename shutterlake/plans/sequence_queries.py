"""Sequence, grouping and log operators over the catalog's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions import numbers, text
from shutterlake.operators import predicates, sequence
from shutterlake.plans.catalog import register
from shutterlake.sources.catalog_views import oracle, view


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "images")


@register("win01_scene_time_chains", oracle("""
    WITH t AS (SELECT id, folder_id, captured_at_ms AS t, CASE WHEN lag(captured_at_ms) OVER w IS NULL OR captured_at_ms - lag(captured_at_ms) OVER w > 120000 THEN 1 ELSE 0 END AS cut
               FROM {images} WHERE captured_at_ms IS NOT NULL WINDOW w AS (PARTITION BY folder_id ORDER BY captured_at_ms, id))
    SELECT id, folder_id, CAST(sum(cut) OVER (PARTITION BY folder_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scene_no FROM t"""))
def win01_scene_time_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes by time alone: a gap of over two minutes starts one."""
    w = Window.partitionBy("folder_id").orderBy("captured_at_ms", "id")
    cut = F.col("captured_at_ms") - F.lag("captured_at_ms").over(w) > 120_000
    timed = _images(spark, sf_dir).select("id", "folder_id", "captured_at_ms").filter("captured_at_ms IS NOT NULL")
    return sequence.sessionize(timed, ["folder_id"], [F.col("captured_at_ms"), F.col("id")], cut, "scene_no").select("id", "folder_id", "scene_no")


@register("win09_recency_weights", oracle("""
    SELECT id, camera_make, pow(0.5E0, (row_number() OVER (PARTITION BY camera_make ORDER BY captured_at_ms DESC NULLS LAST, id DESC) - 1) / 50.0E0) AS weight FROM {images}"""))
def win09_recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("camera_make").orderBy(F.desc_nulls_last("captured_at_ms"), F.desc("id"))) - 1
    return _images(spark, sf_dir).select("id", "camera_make", F.pow(F.lit(0.5), rank / 50.0).alias("weight"))


@register("win11_holdout_tail", oracle("""
    SELECT id, lens, r > n - n // 5 AS held_out FROM
    (SELECT id, trim(lens) AS lens, row_number() OVER (PARTITION BY trim(lens) ORDER BY captured_at_ms, id) AS r, count(*) OVER (PARTITION BY trim(lens)) AS n
     FROM {images} WHERE nullif(trim(lens), '') IS NOT NULL AND captured_at_ms IS NOT NULL) WHERE n >= 25"""))
def win11_holdout_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth of each lens in time, where at least 5 rows are held out and 20 stay."""
    rows = _images(spark, sf_dir).select("id", text.known(F.col("lens")).alias("lens"), "captured_at_ms").filter("lens IS NOT NULL AND captured_at_ms IS NOT NULL")
    r, n = F.row_number().over(Window.partitionBy("lens").orderBy("captured_at_ms", "id")), F.count(F.lit(1)).over(Window.partitionBy("lens"))
    ranked = rows.withColumn("r", r).withColumn("n", n).filter("n >= 25")
    return ranked.select("id", "lens", (F.col("r") > F.col("n") - F.floor(F.col("n") / 5)).alias("held_out"))


@register("win12_value_clusters", oracle("""
    WITH v AS (SELECT DISTINCT folder_id, focal_mm FROM {images} WHERE focal_mm IS NOT NULL),
    c AS (SELECT *, CASE WHEN lag(focal_mm) OVER w IS NULL OR focal_mm - lag(focal_mm) OVER w > 13 THEN 1 ELSE 0 END AS cut FROM v WINDOW w AS (PARTITION BY folder_id ORDER BY focal_mm)),
    n AS (SELECT folder_id, focal_mm, sum(cut) OVER (PARTITION BY folder_id ORDER BY focal_mm) AS cluster FROM c)
    SELECT folder_id, CAST(cluster AS BIGINT) AS cluster, min(focal_mm) AS low, max(focal_mm) AS high, count(*) AS n FROM n GROUP BY folder_id, cluster"""))
def win12_value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage clusters on a line; distinct values first, so that a window holds few rows."""
    values = _images(spark, sf_dir).filter("focal_mm IS NOT NULL").select("folder_id", "focal_mm").distinct()
    w = Window.partitionBy("folder_id").orderBy("focal_mm")
    cut = F.col("focal_mm") - F.lag("focal_mm").over(w) > 13
    named = sequence.sessionize(values, ["folder_id"], [F.col("focal_mm")], cut, "cluster")
    return named.groupBy("folder_id", "cluster").agg(F.min("focal_mm").alias("low"), F.max("focal_mm").alias("high"), F.count(F.lit(1)).alias("n"))


@register("jon12_nearest_in_time", oracle("""
    WITH a AS (SELECT id, folder_id, captured_at_ms AS t FROM {images} WHERE captured_at_ms IS NOT NULL AND pick = 'pick' AND folder_id % 3 <> 0),
    q AS (SELECT id, folder_id, captured_at_ms AS t FROM {images} WHERE captured_at_ms IS NOT NULL AND pick = 'reject'),
    near AS (SELECT q.id, (SELECT min_by(struct_pack(id := a.id, gap := abs(a.t - q.t)), (abs(a.t - q.t), a.t, a.id)) FROM a WHERE a.folder_id = q.folder_id) AS own,
                    (SELECT min_by(struct_pack(id := a.id, gap := abs(a.t - q.t)), (abs(a.t - q.t), a.t, a.id)) FROM a) AS any_key FROM q)
    SELECT id, coalesce(own.id, any_key.id) AS nearest, coalesce(own.gap, any_key.gap) AS gap_ms FROM near"""))
def jon12_nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rejected image the pick nearest in time, of its folder if that has any, else of all; the earlier on a tie."""
    rows = _images(spark, sf_dir).filter("captured_at_ms IS NOT NULL").select("id", "folder_id", F.col("captured_at_ms").alias("t"), "pick")
    anchors = rows.filter("pick = 'pick' AND folder_id % 3 <> 0").select("id", "folder_id", "t")
    targets = rows.filter("pick = 'reject'").select("id", "folder_id", "t")
    own = sequence.nearest(targets, anchors, ["folder_id"], "t", "id")
    lost = targets.join(anchors.select("folder_id").distinct(), "folder_id", "left_anti")
    return own.select("id", "nearest", "gap_ms").unionByName(sequence.nearest(lost, anchors, [], "t", "id").select("id", "nearest", "gap_ms"))


_KEPT = "(pick = 'pick' OR (pick <> 'reject' AND rating >= 1))"
_SUMS = {
    "total": "TRUE", "picked": "pick = 'pick'", "picked_auto": "pick = 'pick' AND pick_origin = 'auto'", "rejected": "pick = 'reject'", "rejected_auto": "pick = 'reject' AND pick_origin = 'auto'", "starred": "rating > 0",
    "starred_unflagged": "pick NOT IN ('pick', 'reject') AND rating >= 1", "suggested_unflagged": "pick NOT IN ('pick', 'reject') AND rating = 0 AND suggested_pick = 'pick'",
    "pending_rejects": "image_id IS NOT NULL AND pick = 'unflagged' AND rating = 0 AND suggested_pick = 'reject'", "pending_picks": "image_id IS NOT NULL AND pick = 'unflagged' AND rating = 0 AND suggested_pick = 'pick'",
    "pending_ratings": "image_id IS NOT NULL AND pick = 'unflagged' AND rating = 0 AND suggested_pick NOT IN ('pick', 'reject') AND suggested_rating > 0", "unanalysed": "image_id IS NULL", "keepers": _KEPT,
}


@register("agg04_cull_summary", oracle(f"""
    WITH s AS (SELECT {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _SUMS.items())} FROM {{images}} i LEFT JOIN {{scores}} q ON q.image_id = i.id)
    SELECT *, total - picked - rejected AS unflagged, rejected - rejected_auto AS rejected_by_user FROM s"""))
def agg04_cull_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen conditional counts in one pass; keepers are picks and what isn't rejected and has a star."""
    scores = view(spark, sf_dir, "scores").select("image_id", "suggested_pick", "suggested_rating")
    df = _images(spark, sf_dir).select("id", "pick", "pick_origin", "rating").join(scores, F.col("id") == F.col("image_id"), "left")
    out = df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _SUMS.items()])
    return out.withColumn("unflagged", F.col("total") - F.col("picked") - F.col("rejected")).withColumn("rejected_by_user", F.col("rejected") - F.col("rejected_auto"))


@register("agg09_selection_counts", oracle("""
    WITH s AS (SELECT t.project_id, t.choice, t.shot_type, t.locked, CASE WHEN t.choice = 'not_sure' THEN 'not_sure' WHEN t.choice <> 'set_aside' THEN NULL
               WHEN i.pick = 'reject' OR coalesce(q.suggested_pick, '') = 'reject' THEN 'defects'
               WHEN json_extract_string(t.reasons_json, '$[0].kind') IN ('near_duplicate', 'not_best_of_setup') OR (t.covered_by IS NOT NULL AND t.covered_similarity >= 0.7E0) THEN 'similar' ELSE 'weaker' END AS pile
               FROM {selection} t LEFT JOIN {images} i ON i.id = t.image_id LEFT JOIN {scores} q ON q.image_id = t.image_id)
    SELECT project_id, 'choice' AS kind, choice AS value, count(*) AS n, count(*) FILTER (locked) AS locked, count(*) FILTER (choice = 'deliver') AS delivered FROM s GROUP BY project_id, choice
    UNION ALL SELECT project_id, 'shot_type', shot_type, count(*), count(*) FILTER (locked), count(*) FILTER (choice = 'deliver') FROM s WHERE shot_type IS NOT NULL GROUP BY project_id, shot_type
    UNION ALL SELECT project_id, 'pile', pile, count(*), count(*) FILTER (locked), 0 FROM s WHERE pile IS NOT NULL GROUP BY project_id, pile"""))
def agg09_selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by choice, shot type and pile from one pre-aggregated table of at most some hundred rows a project."""
    col = F.col
    scores = view(spark, sf_dir, "scores").select(col("image_id").alias("id"), "suggested_pick")
    picks = _images(spark, sf_dir).select("id", "pick").join(scores, "id", "left").withColumnRenamed("id", "image_id")
    rows = view(spark, sf_dir, "selection").join(picks, "image_id", "left")
    rows = rows.withColumn("pile", predicates.pile(col("choice"), col("pick"), col("suggested_pick"), col("reasons_json"), col("covered_by"), col("covered_similarity")))
    small = rows.groupBy("project_id", "choice", "shot_type", "pile").agg(F.count(F.lit(1)).alias("n"), F.count_if("locked").alias("locked"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), col(k).alias("value")) for k in ("choice", "shot_type", "pile")])
    each = small.withColumn("delivered", F.when(col("choice") == "deliver", col("n")).otherwise(F.lit(0).cast("long"))).select("project_id", "n", "locked", "delivered", F.inline(kinds)).filter("value IS NOT NULL")
    return each.groupBy("project_id", "kind", "value").agg(F.sum("n").alias("n"), F.sum("locked").alias("locked"), F.sum("delivered").alias("delivered"))


@register("agg11_scene_columns", oracle("""
    SELECT scene_id, CASE WHEN count(DISTINCT folder_id) = 1 THEN min(folder_id) END AS folder_id, min(captured_at_ms) AS first_ms, max(captured_at_ms) AS last_ms, count(*) AS n
    FROM {images} WHERE scene_id IS NOT NULL GROUP BY scene_id"""))
def agg11_scene_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene's folder, if it has but one. The least and largest folder tell that without a distinct count."""
    low, high = F.min("folder_id"), F.max("folder_id")
    rows = _images(spark, sf_dir).filter("scene_id IS NOT NULL")
    return rows.groupBy("scene_id").agg(F.when(low == high, low).alias("folder_id"), F.min("captured_at_ms").alias("first_ms"), F.max("captured_at_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))


@register("srt05_auto_cover", oracle("""
    SELECT project_id, id AS cover FROM (SELECT f.project_id, i.id, row_number() OVER (PARTITION BY f.project_id ORDER BY i.pick = 'reject', i.pick = 'pick' DESC, i.rating DESC, i.captured_at_ms ASC NULLS LAST, i.file_name, i.id) AS r
    FROM {images} i JOIN {folders} f ON f.id = i.folder_id WHERE f.project_id IS NOT NULL) WHERE r = 1"""))
def srt05_auto_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best image of each project as an aggregate: combined before the shuffle, unlike a ranking window."""
    folders = view(spark, sf_dir, "folders").filter("project_id IS NOT NULL").select(F.col("id").alias("folder_id"), "project_id")
    rows = _images(spark, sf_dir).select("id", "folder_id", "file_name", "pick", "rating", "captured_at_ms").join(folders, "folder_id")
    order = F.struct((F.col("pick") == "reject").alias("a"), (F.col("pick") != "pick").alias("b"), (-F.col("rating")).alias("c"), F.col("captured_at_ms").isNull().alias("d"), F.col("captured_at_ms").alias("e"), "file_name", "id")
    return rows.groupBy("project_id").agg(F.min(order).alias("m")).select("project_id", F.col("m.id").alias("cover"))


@register("set06_not_analysed", oracle("SELECT id FROM {images} WHERE id NOT IN (SELECT image_id FROM {scores})"))
def set06_not_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("id").join(view(spark, sf_dir, "scores").select(F.col("image_id").alias("id")), "id", "left_anti")


@register("set03_tag_difference", oracle("""
    WITH new AS (SELECT image_id, tag, confidence FROM {tags} WHERE image_id % 3 <> 0), old AS (SELECT image_id, tag, CASE WHEN image_id % 5 = 0 THEN 0 ELSE confidence END AS confidence FROM {tags} WHERE image_id % 4 <> 0 AND source = 'auto')
    SELECT coalesce(n.image_id, o.image_id) AS image_id, coalesce(n.tag, o.tag) AS tag, CASE WHEN o.tag IS NULL THEN 'insert' WHEN n.tag IS NULL THEN 'delete' WHEN n.confidence IS DISTINCT FROM o.confidence THEN 'update' ELSE 'keep' END AS action
    FROM new n FULL JOIN old o ON n.image_id = o.image_id AND n.tag = o.tag"""))
def set03_tag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns stored automatic tags into the emitted ones: insert, update, delete or keep."""
    tags = view(spark, sf_dir, "tags")
    new = tags.filter("image_id % 3 <> 0").select("image_id", "tag", F.col("confidence").alias("new"), F.lit(True).alias("emitted"))
    old = tags.filter("image_id % 4 <> 0 AND source = 'auto'").select("image_id", "tag", F.when(F.col("image_id") % 5 == 0, 0).otherwise(F.col("confidence")).alias("old"), F.lit(True).alias("stored"))
    both = new.join(old, ["image_id", "tag"], "full")
    action = F.when(F.col("stored").isNull(), "insert").when(F.col("emitted").isNull(), "delete").when(~F.col("new").eqNullSafe(F.col("old")), "update").otherwise("keep")
    return both.select("image_id", "tag", action.alias("action"))


@register("grp03_demote_members", oracle("""
    SELECT i.id, CASE WHEN i.pick = 'pick' THEN 'unflagged' ELSE i.pick END AS pick, least(i.rating, greatest(k.rating - 1, 0)) AS rating
    FROM {images} i JOIN {bursts} b ON b.id = i.burst_id JOIN {images} k ON k.id = b.keeper_id WHERE i.id <> b.keeper_id"""))
def grp03_demote_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burst members other than the keeper lose a pick and rank below the keeper's stars."""
    images = _images(spark, sf_dir).select("id", "burst_id", "pick", "rating")
    keepers = view(spark, sf_dir, "bursts").select(F.col("id").alias("burst_id"), "keeper_id").filter("keeper_id IS NOT NULL")
    best = images.select(F.col("id").alias("keeper_id"), F.col("rating").alias("top")).join(keepers, "keeper_id")
    out = images.join(best, "burst_id").filter("id <> keeper_id")
    return out.select("id", F.when(F.col("pick") == "pick", "unflagged").otherwise(F.col("pick")).alias("pick"), F.least("rating", F.greatest(F.col("top") - 1, F.lit(0))).alias("rating"))


@register("sel06_apply_plan", oracle("""
    WITH q AS (SELECT i.id, i.pick, i.pick <> 'unflagged' AND coalesce(i.pick_origin, 'user') <> 'auto' AS own,
               CASE WHEN q.image_id IS NULL THEN NULL WHEN s.choice = 'deliver' THEN 'pick' WHEN q.suggested_pick = 'pick' THEN 'unflagged' ELSE q.suggested_pick END AS want
               FROM {selection} s JOIN {images} i ON i.id = s.image_id LEFT JOIN {scores} q ON q.image_id = i.id),
    n AS (SELECT *, want = 'reject' AND pick <> 'reject' AS new_reject FROM q)
    SELECT id, CASE WHEN own THEN 'protected' WHEN want IS NULL OR (CASE WHEN new_reject THEN 'unflagged' ELSE want END) = pick THEN 'unchanged' WHEN new_reject THEN 'set_unflagged' ELSE 'set_' || want END AS action,
           NOT own AND coalesce(new_reject, FALSE) AS rejectable FROM n"""))
def sel06_apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying the selection without new rejects would do to each photo; flags of the user's own stay."""
    scores = view(spark, sf_dir, "scores").select(F.col("image_id").alias("id"), "suggested_pick", F.lit(True).alias("scored"))
    df = view(spark, sf_dir, "selection").select(F.col("image_id").alias("id"), "choice").join(_images(spark, sf_dir).select("id", "pick", "pick_origin"), "id").join(scores, "id", "left")
    want = F.when(F.col("scored"), predicates.overlay(F.col("choice"), F.col("suggested_pick")))
    own = (F.col("pick") != "unflagged") & ~F.col("pick_origin").eqNullSafe(F.lit("auto"))
    df = df.select("id", "pick", own.alias("own"), want.alias("want")).withColumn("rejectable", F.coalesce((F.col("want") == "reject") & (F.col("pick") != "reject"), F.lit(False)) & ~F.col("own"))
    put = F.when(F.col("rejectable"), "unflagged").otherwise(F.col("want"))
    return df.select("id", F.when(F.col("own"), "protected").when(put.isNull() | (put == F.col("pick")), "unchanged").otherwise(F.concat(F.lit("set_"), put)).alias("action"), "rejectable")


@register("stm08_history_coalesced", oracle("""
    WITH h AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE ts IS NOT NULL),
    c AS (SELECT *, CASE WHEN r > 2 AND lag(event_type) OVER w = event_type AND t - lag(t) OVER w <= 3600000 THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY r)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS entry FROM c),
    e AS (SELECT user_id, min_by(event_id, r) AS event_id, count(*) AS commits, min(r) AS r FROM g GROUP BY user_id, entry),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS place FROM e)
    SELECT event_id, user_id, commits, place FROM p WHERE place <= 19 OR r = 1"""))
def stm08_history_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a commit of the last entry's label, soon after its update, updates that entry, whose id stays.

    The first entry is the original: nothing merges into it, and it is never pruned; of the others the newest stay, so
    that there are 20 in all.
    """
    h = view(spark, sf_dir, "events").filter("ts IS NOT NULL").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    same = (F.lag("event_type").over(w) == F.col("event_type")) & (F.col("t") - F.lag("t").over(w) <= 3_600_000) & (F.row_number().over(w) > 2)
    entries = sequence.sessionize(h, ["user_id"], [F.col("t"), F.col("event_id")], ~F.coalesce(same, F.lit(False)), "entry")
    entries = entries.groupBy("user_id", "entry").agg(F.min(F.struct("t", "event_id")).alias("first"), F.count(F.lit(1)).alias("commits"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("entry"))).cast("long")
    return entries.withColumn("place", place).filter("place <= 19 OR entry = 1").select("first.event_id", "user_id", "commits", "place")


@register("mth08_exposure_value", oracle("""
    SELECT id, CASE WHEN iso > 0 AND shutter_s > 0 AND aperture > 0 THEN log2(aperture * aperture / shutter_s) - log2(iso / 100.0E0) END AS ev100 FROM {images}"""))
def mth08_exposure_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("id", numbers.ev100(F.col("iso"), F.col("shutter_s"), F.col("aperture")).alias("ev100"))


@register("mth03_burst_hash_similarity", oracle("""
    SELECT id, previous, greatest(1 - bit_count(xor(phash, before)) / 32.0E0, 0) AS similarity FROM
    (SELECT id, phash, lag(id) OVER w AS previous, lag(phash) OVER w AS before FROM {images} WHERE phash IS NOT NULL AND burst_id IS NOT NULL WINDOW w AS (PARTITION BY burst_id ORDER BY id)) WHERE previous IS NOT NULL"""))
def mth03_burst_hash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("burst_id").orderBy("id")
    rows = _images(spark, sf_dir).filter("phash IS NOT NULL AND burst_id IS NOT NULL").select("id", "phash", F.lag("id").over(w).alias("previous"), F.lag("phash").over(w).alias("before"))
    return rows.filter("previous IS NOT NULL").select("id", "previous", numbers.hash_similarity(F.col("phash"), F.col("before")).alias("similarity"))


@register("prj03_nested_tags", oracle("SELECT i.id, coalesce(t.tags, '') AS tags FROM {images} i LEFT JOIN (SELECT image_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM {tags} WHERE NOT suppressed GROUP BY image_id) t ON t.image_id = i.id"))
def prj03_nested_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = view(spark, sf_dir, "tags").filter("NOT suppressed").groupBy(F.col("image_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))
    return _images(spark, sf_dir).select("id").join(per, "id", "left").select("id", F.coalesce("tags", F.lit("")).alias("tags"))


@register("dat03_day_counts", oracle("SELECT captured_at_ms - captured_at_ms % 86400000 AS day_ms, count(*) AS n FROM {images} WHERE captured_at_ms IS NOT NULL GROUP BY 1"))
def dat03_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).filter("captured_at_ms IS NOT NULL").groupBy(numbers.day_of(F.col("captured_at_ms")).alias("day_ms")).agg(F.count(F.lit(1)).alias("n"))


@register("agg17_scene_medians", oracle("SELECT scene_id, median(focal_mm) AS focal_mm, count(focal_mm) AS n FROM {images} WHERE scene_id IS NOT NULL GROUP BY scene_id"))
def agg17_scene_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).filter("scene_id IS NOT NULL").groupBy("scene_id").agg(F.median("focal_mm").alias("focal_mm"), F.count("focal_mm").alias("n"))
