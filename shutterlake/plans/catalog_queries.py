"""Filters, sorts, facets and summaries of the catalog, over the views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions import numbers, text
from shutterlake.operators import predicates, query
from shutterlake.operators.query import CatalogQuery
from shutterlake.plans.catalog import register
from shutterlake.sources.catalog_views import oracle, view

_TABLES = ("images", "scores", "tags", "bursts", "adjustments", "selection")


def tables(spark: SparkSession, sf_dir: str) -> query.Catalog:
    return query.Catalog(*[view(spark, sf_dir, n) for n in _TABLES])


def _filter(name: str, q: CatalogQuery, where: str, joins: str = "") -> None:
    """Register the ids and ratings of the images that match q, and the same in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.filtered(tables(spark, sf_dir), q).select("id", "rating")

    register(name, oracle(f"SELECT i.id, i.rating FROM {{images}} i {joins} WHERE {where}"))(run)


_SCORES = "LEFT JOIN {scores} s ON s.image_id = i.id"
_filter("flt02_in_lists", CatalogQuery(picks=["pick", "unflagged"], colors=["red", "green"], formats=["arw", "jpeg", "heic"]), "pick IN ('pick', 'unflagged') AND color_label IN ('red', 'green') AND format IN ('arw', 'jpeg', 'heic')")
_filter("flt03_rating_range", CatalogQuery(min_rating=2, max_rating=4), "rating BETWEEN 2 AND 4")
_filter("flt04_tolerant_range", CatalogQuery(iso=(200, 500), shutter=(1 / 240, 1 / 120)), "iso BETWEEN 200 * 0.999999E0 AND 500 * 1.000001E0 AND shutter_s BETWEEN (1.0E0 / 240) * 0.999999E0 AND (1.0E0 / 120) * 1.000001E0")
_filter("flt05_rounded_range", CatalogQuery(focal=(23.0, 48.0), aperture=(2.1, 2.8)), "round(focal_mm, 1) BETWEEN 23 * 0.999999E0 AND 48 * 1.000001E0 AND round(aperture, 1) BETWEEN 2.1E0 * 0.999999E0 AND 2.8E0 * 1.000001E0")
_filter("flt06_half_open_time", CatalogQuery(captured=(1700000070000, 1700003500000)), "captured_at_ms >= 1700000070000 AND captured_at_ms < 1700003500000")
_filter("flt07_tag_any", CatalogQuery(tags=["t1", "t4"]), "i.id IN (SELECT image_id FROM {tags} WHERE NOT suppressed AND tag IN ('t1', 't4'))")
_filter("flt08_tag_all", CatalogQuery(tags=["t1", "t4", "t1"], tag_match="all"), "i.id IN (SELECT image_id FROM {tags} WHERE NOT suppressed AND tag IN ('t1', 't4') GROUP BY image_id HAVING count(DISTINCT tag) = 2)")
_filter("flt09_tag_exclude", CatalogQuery(exclude_tags=["t0", "t2"]), "i.id NOT IN (SELECT image_id FROM {tags} WHERE NOT suppressed AND tag IN ('t0', 't2'))")
_filter("flt10_flag_origin_auto", CatalogQuery(pick_origin="auto"), "pick <> 'unflagged' AND pick_origin = 'auto'")
_filter("flt10_flag_origin_user", CatalogQuery(pick_origin="user"), "pick <> 'unflagged' AND coalesce(pick_origin, 'user') <> 'auto'")
_filter("flt11_collapse_bursts", CatalogQuery(collapse_bursts=True), "NOT EXISTS (SELECT 1 FROM {bursts} b WHERE b.id = i.burst_id AND b.keeper_id <> i.id)")
_filter("flt11_collapse_of_unflagged", CatalogQuery(collapse_bursts=True, picks=["unflagged"], max_rating=3), "pick = 'unflagged' AND rating <= 3 AND NOT EXISTS (SELECT 1 FROM {bursts} b WHERE b.id = i.burst_id AND b.keeper_id <> i.id)")
_filter("flt12_keeper_not_rejected", CatalogQuery(keeper_rule="not_rejected"), "pick <> 'reject'")
_filter("flt12_keeper_chosen", CatalogQuery(keeper_rule="chosen", keeper_min_rating=2), "pick = 'pick' OR (pick <> 'reject' AND rating >= 2)")
_filter("flt12_keeper_suggested", CatalogQuery(keeper_rule="chosen", keeper_min_rating=3, keeper_suggestions=True), "pick = 'pick' OR (pick <> 'reject' AND (rating >= 3 OR (rating = 0 AND coalesce(s.suggested_pick, '') = 'pick')))", _SCORES)
_filter("flt13_pending_suggestion", CatalogQuery(suggested=["pick"]), "pick = 'unflagged' AND rating = 0 AND s.suggested_pick = 'pick'", _SCORES)
_filter("flt13_pending_rating", CatalogQuery(suggested=["rating", "reject"]), "pick = 'unflagged' AND rating = 0 AND (s.suggested_pick = 'reject' OR (s.suggested_pick NOT IN ('pick', 'reject') AND s.suggested_rating > 0))", _SCORES)
_filter("flt14_edited", CatalogQuery(edited=True), "EXISTS (SELECT 1 FROM {adjustments} a WHERE a.image_id = i.id AND NOT a.neutral)")
_filter("flt14_not_edited", CatalogQuery(edited=False), "NOT EXISTS (SELECT 1 FROM {adjustments} a WHERE a.image_id = i.id AND NOT a.neutral)")
_filter("flt15_cameras", CatalogQuery(cameras=[("sony", "M1"), ("canon", None), ("fujifilm", "M2", None)]), "(camera_make = 'sony' AND trim(camera_model) = 'M1') OR (camera_make = 'canon' AND nullif(trim(camera_model), '') IS NULL) OR (camera_make = 'fujifilm' AND trim(camera_model) = 'M2' AND nullif(trim(camera_serial), '') IS NULL)")
_filter("flt16_list_with_null", CatalogQuery(lenses=["FE 23mm", None]), "trim(lens) = 'FE 23mm' OR nullif(trim(lens), '') IS NULL")
_filter("flt17_reason_kind", CatalogQuery(reason_kinds=["blink", "missed_focus"]), "CASE WHEN json_valid(s.reasons_json) THEN json_extract_string(s.reasons_json, '$[0].kind') END IN ('blink', 'missed_focus')", _SCORES)
_PILE = """CASE WHEN t.choice = 'not_sure' THEN 'not_sure' WHEN t.choice <> 'set_aside' THEN NULL WHEN pick = 'reject' OR coalesce(s.suggested_pick, '') = 'reject' THEN 'defects'
    WHEN json_extract_string(t.reasons_json, '$[0].kind') IN ('near_duplicate', 'not_best_of_setup') OR (t.covered_by IS NOT NULL AND t.covered_similarity >= 0.7E0) THEN 'similar' ELSE 'weaker' END"""
for _pile in ("not_sure", "similar", "weaker", "defects"):
    _filter(f"flt18_pile_{_pile}", CatalogQuery(piles=[_pile]), f"{_PILE} = '{_pile}'", f"{_SCORES} JOIN {{selection}} t ON t.image_id = i.id")
_filter("flt19_scope_many", CatalogQuery(folder_ids=[1, 4, 9]), "folder_id IN (1, 4, 9)")
_filter("flt19_scope_none", CatalogQuery(folder_ids=[]), "1 = 0")
_filter("flt20_choices", CatalogQuery(choices=["deliver", "alternative"]), "i.id IN (SELECT image_id FROM {selection} WHERE choice IN ('deliver', 'alternative'))")
_filter("flt21_missing", CatalogQuery(missing_only=True, sidecar=True), "missing_since_ms IS NOT NULL AND xmp_mtime_ms IS NOT NULL")
_filter(
    "flt01_all_clauses",
    CatalogQuery(folder_ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], picks=["pick", "unflagged"], min_rating=1, tags=["t1", "t2", "t3"], exclude_tags=["t5"], iso=(100, 700), keeper_rule="not_rejected", extensions=["jpg", "arw", "cr3", ""], text="img_"),
    """folder_id BETWEEN 0 AND 9 AND pick IN ('pick', 'unflagged') AND rating >= 1 AND iso BETWEEN 99 AND 701 AND lower(file_name) LIKE '%img\\_%' ESCAPE '\\'
    AND CASE WHEN instr(file_name, '.') = 0 THEN '' ELSE lower(regexp_extract(file_name, '[^.]*$')) END IN ('jpg', 'arw', 'cr3', '')
    AND i.id IN (SELECT image_id FROM {tags} WHERE NOT suppressed AND tag IN ('t1', 't2', 't3')) AND i.id NOT IN (SELECT image_id FROM {tags} WHERE NOT suppressed AND tag = 't5')""",
)

_ORDERS = {
    "capture_time": ("captured_at_ms ASC NULLS LAST, file_name, id", "captured_at_ms DESC NULLS LAST, file_name DESC, id DESC"),
    "file_name": ("file_name, id", "file_name DESC, id DESC"),
    "quality": ("overall DESC NULLS LAST, id", "overall ASC NULLS LAST, id DESC"),
    "rating": ("rating DESC, captured_at_ms ASC NULLS LAST, file_name, id", "rating ASC, captured_at_ms ASC NULLS LAST, file_name, id"),
    "target_moment": (
        "m.moment_id IS NULL, m.started ASC NULLS LAST, m.moment_id, m.score DESC NULLS LAST, captured_at_ms ASC NULLS LAST, file_name, id",
        "m.moment_id IS NULL, m.started DESC NULLS FIRST, m.moment_id DESC, m.score DESC NULLS LAST, captured_at_ms ASC NULLS LAST, file_name, id",
    ),
}
_MOMENTS = """LEFT JOIN (SELECT t.image_id, t.moment_id, t.score, min(k.captured_at_ms) OVER (PARTITION BY t.moment_id) AS started
    FROM {selection} t JOIN {images} k ON k.id = t.image_id) m ON m.image_id = i.id"""


def _sort(sort: str, descending: bool) -> None:
    """Register the ids of a page, by a sort of the catalog."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.page_ids(tables(spark, sf_dir), CatalogQuery(sort=sort, descending=descending, offset=7, limit=200)).select(F.col("pos").cast("long").alias("pos"), "id")

    order = _ORDERS[sort][descending]
    joins = _MOMENTS if sort == "target_moment" else _SCORES
    sql = f"SELECT pos, id FROM (SELECT i.id, row_number() OVER (ORDER BY {order}) AS pos FROM {{images}} i {joins}) WHERE pos BETWEEN 8 AND 207"
    register(f"srt01_{sort}_{'down' if descending else 'up'}", oracle(sql))(run)


for _name in _ORDERS:
    _sort(_name, False)
    _sort(_name, True)


_PENDING = "pick = 'unflagged' AND rating = 0 AND s.suggested_pick"


@register("agg01_filter_counts", oracle(f"""
    SELECT count(*) AS total, {", ".join(f"count(*) FILTER (rating = {r}) AS r{r}" for r in range(6))}, count(*) FILTER (pick = 'pick') AS picks, count(*) FILTER (pick = 'reject') AS rejects,
           count(*) FILTER (pick NOT IN ('pick', 'reject')) AS unflagged, count(DISTINCT burst_id) AS bursts,
           (SELECT count(*) FROM {{images}} k JOIN {{bursts}} b ON b.id = k.burst_id WHERE b.keeper_id <> k.id) AS non_keepers,
           count(*) FILTER (missing_since_ms IS NOT NULL) AS missing, count(*) FILTER ({_PENDING} = 'pick') AS suggested_picks, count(*) FILTER ({_PENDING} = 'reject') AS suggested_rejects,
           count(*) FILTER ({_PENDING} NOT IN ('pick', 'reject') AND s.suggested_rating > 0) AS suggested_ratings
    FROM {{images}} i LEFT JOIN {{scores}} s ON s.image_id = i.id"""))
def agg01_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "scores").select(F.col("image_id").alias("id"), "suggested_pick", "suggested_rating")
    keepers = view(spark, sf_dir, "bursts").select(F.col("id").alias("burst_id"), "keeper_id")
    df = view(spark, sf_dir, "images").select("id", "pick", "rating", "burst_id", "missing_since_ms").join(scores, "id", "left").join(keepers, "burst_id", "left")
    pick, rating, told = F.col("pick"), F.col("rating"), F.col("suggested_pick")
    pending = (pick == "unflagged") & (rating == 0)
    return df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(rating == r).alias(f"r{r}") for r in range(6)], F.count_if(pick == "pick").alias("picks"), F.count_if(pick == "reject").alias("rejects"),
        F.count_if(~pick.isin("pick", "reject")).alias("unflagged"), F.countDistinct("burst_id").alias("bursts"), F.count_if(F.col("keeper_id") != F.col("id")).alias("non_keepers"), F.count_if(F.col("missing_since_ms").isNotNull()).alias("missing"),
        F.count_if(pending & (told == "pick")).alias("suggested_picks"), F.count_if(pending & (told == "reject")).alias("suggested_rejects"), F.count_if(pending & ~told.isin("pick", "reject") & (F.col("suggested_rating") > 0)).alias("suggested_ratings"),
    )


@register("agg01_tag_counts", oracle("SELECT tag, count(*) AS n FROM {tags} WHERE NOT suppressed GROUP BY tag"))
def agg01_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tags").filter("NOT suppressed").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@register("agg05_cascading_facets", oracle("""
    WITH f AS (SELECT * FROM {images})
    SELECT 'format' AS facet, format AS value, count(*) AS n FROM f WHERE rating >= 2 AND iso BETWEEN 199 AND 501 GROUP BY format
    UNION ALL SELECT 'iso', CAST(iso AS VARCHAR), count(*) FROM f WHERE rating >= 2 AND format IN ('arw', 'jpeg') GROUP BY iso
    UNION ALL SELECT 'lens', nullif(trim(lens), ''), count(*) FROM f WHERE rating >= 2 AND iso BETWEEN 199 AND 501 AND format IN ('arw', 'jpeg') GROUP BY nullif(trim(lens), '')
    UNION ALL SELECT 'sidecar', CASE WHEN xmp_mtime_ms IS NOT NULL THEN 'true' ELSE 'false' END, count(*) FROM f WHERE rating >= 2 AND iso BETWEEN 199 AND 501 AND format IN ('arw', 'jpeg') GROUP BY xmp_mtime_ms IS NOT NULL"""))
def agg05_cascading_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = CatalogQuery(min_rating=2, iso=(200, 500), formats=["arw", "jpeg"])
    return query.facet_counts(tables(spark, sf_dir), q, ["format", "iso", "lens", "sidecar"])


@register("agg07_project_rollup", oracle("""
    SELECT p.id, p.name, count(DISTINCT f.id) AS folders, count(i.id) AS photos, count(*) FILTER (i.pick <> 'reject' AND (i.pick = 'pick' OR i.rating >= 1)) AS keepers,
           min(i.captured_at_ms) AS first_ms, max(i.captured_at_ms) AS last_ms
    FROM {projects} p LEFT JOIN {folders} f ON f.project_id = p.id LEFT JOIN {images} i ON i.folder_id = f.id GROUP BY p.id, p.name"""))
def agg07_project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "images")
    kept = predicates.keeper("chosen", F.col("pick"), F.col("rating"), F.lit(None).cast("string"))
    per = images.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("k"), F.min("captured_at_ms").alias("a"), F.max("captured_at_ms").alias("b"))
    folders = view(spark, sf_dir, "folders").select(F.col("id").alias("folder_id"), "project_id")
    done = folders.join(per, "folder_id", "left").groupBy("project_id").agg(F.count("folder_id").alias("folders"), F.sum("n").alias("photos"), F.sum("k").alias("keepers"), F.min("a").alias("first_ms"), F.max("b").alias("last_ms"))
    out = view(spark, sf_dir, "projects").join(done, F.col("id") == F.col("project_id"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("folders", "photos", "keepers")]
    return out.select("id", "name", *zero, "first_ms", "last_ms")


@register("agg12_latest_per_key", oracle("SELECT scene_id, max(id) AS id, arg_max(rating, id) AS rating FROM {images} WHERE scene_id IS NOT NULL GROUP BY scene_id"))
def agg12_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "images").filter("scene_id IS NOT NULL").groupBy("scene_id").agg(F.max("id").alias("id"), F.max_by("rating", "id").alias("rating"))


@register("agg13_pair_counts", oracle("""
    SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM {tags} a JOIN {tags} b ON a.image_id = b.image_id AND a.tag < b.tag GROUP BY a.tag, b.tag"""))
def agg13_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "tags").select("image_id", "tag")
    a, b = t.withColumnRenamed("tag", "tag_a"), t.withColumnRenamed("tag", "tag_b")
    return a.join(b, "image_id").filter("tag_a < tag_b").groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("n"))


@register("win03_rank_within_parent", oracle("""
    SELECT image_id, alternative_of, r AS place, r > 8 AS demoted FROM
    (SELECT image_id, alternative_of, row_number() OVER (PARTITION BY alternative_of ORDER BY score DESC, image_id) AS r FROM {selection} WHERE alternative_of IS NOT NULL)"""))
def win03_rank_within_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("alternative_of").orderBy(F.desc("score"), "image_id")).cast("long")
    return view(spark, sf_dir, "selection").filter("alternative_of IS NOT NULL").select("image_id", "alternative_of", r.alias("place"), (r > 8).alias("demoted"))


@register("grp17_similarity_tiers", oracle("""
    SELECT CASE WHEN similarity >= 0.9E0 THEN 'near_identical' WHEN similarity >= 0.7E0 THEN 'very_similar' ELSE 'same_moment' END AS tier, count(*) AS n FROM {edges} GROUP BY 1"""))
def grp17_similarity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges").groupBy(numbers.tier(F.col("similarity"), F.lit(True)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register("grp16_refresh_covers", oracle("""
    WITH e AS (SELECT image_a AS a, image_b AS b, similarity FROM {edges} UNION ALL SELECT image_b, image_a, similarity FROM {edges}),
    d AS (SELECT image_id FROM {selection} WHERE choice = 'deliver'),
    r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM e JOIN d ON d.image_id = b)
    SELECT s.image_id, coalesce(r.b, k.image_id) AS cover FROM {selection} s LEFT JOIN r ON r.a = s.image_id AND r.r = 1 LEFT JOIN d k ON k.image_id = s.covered_by WHERE s.choice <> 'deliver'"""))
def grp16_refresh_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sel, e = view(spark, sf_dir, "selection"), view(spark, sf_dir, "edges")
    both = e.select(F.col("image_a").alias("a"), F.col("image_b").alias("b"), "similarity").unionByName(e.select(F.col("image_b").alias("a"), F.col("image_a").alias("b"), "similarity"))
    given = sel.filter("choice = 'deliver'").select(F.col("image_id").alias("b"))
    best = both.join(given, "b", "left_semi").groupBy("a").agg(F.max(F.struct("similarity", (-F.col("b")).alias("nb"))).alias("m")).select(F.col("a").alias("image_id"), (-F.col("m.nb")).alias("best"))
    out = sel.filter("choice <> 'deliver'").join(best, "image_id", "left").join(given.withColumnRenamed("b", "kept"), F.col("covered_by") == F.col("kept"), "left")
    return out.select("image_id", F.coalesce("best", "kept").alias("cover"))


@register("sel05_overlay", oracle("""
    SELECT q.image_id, CASE WHEN s.choice = 'deliver' THEN 'pick' WHEN s.choice IS NOT NULL AND q.suggested_pick = 'pick' THEN 'unflagged' ELSE q.suggested_pick END AS overlay
    FROM {scores} q LEFT JOIN {selection} s ON s.image_id = q.image_id"""))
def sel05_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "scores").select("image_id", "suggested_pick").join(view(spark, sf_dir, "selection").select("image_id", "choice"), "image_id", "left")
    return df.select("image_id", predicates.overlay(F.col("choice"), F.col("suggested_pick")).alias("overlay"))


_SIDECAR = "CASE WHEN id % 10 = 1 THEN NULL ELSE 1699999999999 + (id % 53) END"


@register("stm05_newest_wins", oracle(f"""
    SELECT id, CASE WHEN m IS NULL OR m = xmp_mtime_ms THEN 'write' WHEN meta_updated_ms IS NULL OR m > meta_updated_ms THEN 'read' ELSE 'write' END AS decision
    FROM (SELECT *, {_SIDECAR} AS m FROM {{images}} WHERE xmp_dirty)"""))
def stm05_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For changed images: a sidecar that isn't ours and is newer than the catalog is read, else ours is written."""
    m, own = F.expr(_SIDECAR), F.col("meta_updated_ms")
    moved = m.isNotNull() & ~m.eqNullSafe(F.col("xmp_mtime_ms"))
    return view(spark, sf_dir, "images").filter("xmp_dirty").select("id", F.when(moved & (own.isNull() | (m > own)), "read").otherwise("write").alias("decision"))


@register("str01_names", oracle("""
    SELECT id, CASE WHEN instr(file_name, '.') = 0 THEN '' ELSE lower(regexp_extract(file_name, '[^.]*$')) END AS ext,
           CASE WHEN instr(file_name, '.') = 0 THEN file_name ELSE regexp_replace(file_name, '\\.[^.]*$', '') END AS stem, nullif(trim(lens), '') AS lens FROM {images}"""))
def str01_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("file_name")
    return view(spark, sf_dir, "images").select("id", text.extension(name).alias("ext"), text.stem(name).alias("stem"), text.known(F.col("lens")).alias("lens"))


@register("jon11_folder_by_prefix", oracle("""
    SELECT i.id, max(f.path) AS folder FROM (SELECT id, concat('/', CAST(folder_id % 5 AS VARCHAR), '/x/', file_name) AS path FROM {images}) i
    JOIN (SELECT DISTINCT concat('/', CAST(project_id AS VARCHAR)) AS path FROM {folders} WHERE project_id IS NOT NULL) f ON starts_with(i.path, concat(f.path, '/')) GROUP BY i.id"""))
def jon11_folder_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest folder that contains a path: each path gives its own prefixes, so the join has an equal key."""
    images = view(spark, sf_dir, "images").select("id", F.concat(F.lit("/"), (F.col("folder_id") % 5).cast("string"), F.lit("/x/"), "file_name").alias("path"))
    parts = F.split("path", "/")
    above = images.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    folders = view(spark, sf_dir, "folders").filter("project_id IS NOT NULL").select(F.concat(F.lit("/"), F.col("project_id").cast("string")).alias("folder")).distinct()
    return above.join(folders, "folder", "left_semi").groupBy("id").agg(F.max_by("folder", F.length("folder")).alias("folder"))
