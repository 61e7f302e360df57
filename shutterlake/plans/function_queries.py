"""Scalar functions, nested rows, pages and scores of the catalog, each as a query over its views with SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions import numbers, text
from shutterlake.operators import query, scoring, sequence
from shutterlake.operators.query import CatalogQuery
from shutterlake.plans.catalog import register
from shutterlake.plans.catalog_queries import tables
from shutterlake.sources.catalog_views import oracle, view


def scalar(name: str, columns: Callable[[], dict[str, Column]], sql: str, source: str = "images", key: str = "id") -> None:
    """Register columns over a view; sql has the same names over `{source} v`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select(key, *[x.alias(n) for n, x in columns().items()])

    register(name, oracle(f"SELECT {key}, {sql} FROM {{{source}}} v"))(run)


def c(name: str) -> Column:
    return F.col(name)


def _path() -> Column:
    return F.concat(F.lit("/cards/"), c("folder_id").cast("string"), F.lit("/"), c("file_name"))


_SQL_PATH = "concat('/cards/', CAST(folder_id AS VARCHAR), '/', file_name)"


def _title() -> Column:
    return F.concat(F.lit("Été: "), F.coalesce(c("lens"), F.lit("a/b\\c")), F.lit(" "), c("file_name"))
_SQL_TITLE = "concat('Été: ', coalesce(lens, 'a/b\\c'), ' ', file_name)"

scalar("str03_basename", lambda: {"base": text.basename(_path())}, f"regexp_extract({_SQL_PATH}, '[^/]*$') AS base")
scalar("str05_inside", lambda: {"one": text.inside(_path(), F.lit("/cards/1")), "ten": text.inside(_path(), F.lit("/cards/1/IMG"))}, f"starts_with({_SQL_PATH}, '/cards/1/') AS one, starts_with({_SQL_PATH}, '/cards/1/IMG/') AS ten")
scalar("str07_safe_name", lambda: {"safe": text.safe_name(_title())}, f"replace(replace(replace({_SQL_TITLE}, '/', '_'), '\\', '_'), ':', '_') AS safe")
scalar("str12_slug", lambda: {"slug": text.slug(_title())}, f"regexp_replace(regexp_replace(lower({_SQL_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug")
scalar("str09_fit_bytes", lambda: {"fit": text.fit_bytes(F.concat(F.repeat(F.lit("é€"), (c("id") % 7).cast("int")), c("file_name")), 16)}, """
    CASE WHEN octet_length(encode(concat(repeat('é€', CAST(id % 7 AS BIGINT)), file_name))) <= 16 THEN concat(repeat('é€', CAST(id % 7 AS BIGINT)), file_name)
         ELSE (SELECT max_by(p, n) FROM (SELECT n, substring(concat(repeat('é€', CAST(v.id % 7 AS BIGINT)), v.file_name), 1, CAST(n AS BIGINT)) AS p FROM range(17) r(n)) x WHERE octet_length(encode(p)) <= 16) END AS fit""")
scalar("str08_template", lambda: {"name": text.expand("{date:YYYY-MM-DD}_{camera}_{seq:5}_{filename}", {"date": c("captured_at_ms"), "camera": F.coalesce(text.known(c("camera_model")), F.lit("Unknown")), "seq": c("id"), "filename": c("file_name"), "id": c("id")})}, """
    concat(coalesce(strftime(epoch_ms(captured_at_ms), '%Y-%m-%d'), ''), '_', coalesce(nullif(trim(camera_model), ''), 'Unknown'), '_', lpad(CAST(id AS VARCHAR), 5, '0'), '_', file_name) AS name""")
scalar("dat01_exif_time", lambda: {"ms": numbers.exif_ms(F.date_format(F.timestamp_millis(c("captured_at_ms")), "yyyy:MM:dd HH:mm:ss"), (c("id") % 1000).cast("string")), "bad": numbers.exif_ms(F.lit("2023:13:40 25:00:00"))}, """
    captured_at_ms - captured_at_ms % 1000 + CAST(rpad(CAST(id % 1000 AS VARCHAR), 3, '0') AS BIGINT) AS ms, CAST(NULL AS BIGINT) AS bad""")
scalar("dat02_civil", lambda: {"year": F.year(F.timestamp_millis(c("captured_at_ms") - 2_000_000_000_000)), "day": F.dayofmonth(F.timestamp_millis(c("captured_at_ms") - 2_000_000_000_000))}, "CAST(year(epoch_ms(captured_at_ms - 2000000000000)) AS INTEGER) AS year, CAST(day(epoch_ms(captured_at_ms - 2000000000000)) AS INTEGER) AS day")
scalar("dat04_tokens", lambda: {"t": text.date_text(c("captured_at_ms"), "YY.MM.DD hh-mm-ss")}, "strftime(epoch_ms(captured_at_ms), '%y.%m.%d %H-%M-%S') AS t")
scalar("dat05_zoned_time", lambda: {"ms": numbers.zoned_ms(F.concat(F.date_format(F.timestamp_millis(c("captured_at_ms")), "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("")), (c("id") % 3 + 1).cast("int"))))}, """
    captured_at_ms - captured_at_ms % 1000 - CASE id % 3 WHEN 1 THEN 7200000 ELSE 0 END AS ms""")
scalar("mth01_round_clamp", lambda: {"r": F.round(c("focal_mm"), 1), "k": numbers.clamp(c("aperture"), 1.5, 2.5)}, "round(focal_mm, 1) AS r, CASE WHEN aperture IS NOT NULL THEN least(greatest(aperture, 1.5E0), 2.5E0) END AS k")
scalar("mth02_ramp", lambda: {"r": numbers.ramp(23.0, 60.0, c("focal_mm"))}, "CASE WHEN focal_mm IS NOT NULL THEN least(greatest((focal_mm - 23.0E0) / 37.0E0, 0), 1) END AS r")
scalar("mth06_known_mean", lambda: {"m": numbers.known_mean((0.55, c("eyes_open")), (0.3, c("face_sharpness")), (0.15, c("composition")))}, """
    CASE WHEN eyes_open IS NULL AND face_sharpness IS NULL AND composition IS NULL THEN 0.0E0 ELSE (coalesce(eyes_open * 0.55E0, 0) + coalesce(face_sharpness * 0.3E0, 0) + coalesce(composition * 0.15E0, 0))
      / (CASE WHEN eyes_open IS NULL THEN 0 ELSE 0.55E0 END + CASE WHEN face_sharpness IS NULL THEN 0 ELSE 0.3E0 END + CASE WHEN composition IS NULL THEN 0 ELSE 0.15E0 END) END AS m""", "scores", "image_id")
scalar("mth07_link_threshold", lambda: {"t": numbers.link_threshold(F.when(c("id") % 10 > 0, c("id") * 37 % 400_000))}, """
    CASE WHEN id % 10 = 0 THEN 0.78E0 WHEN id * 37 % 400000 <= 2000 THEN 0.3E0 WHEN id * 37 % 400000 <= 30000 THEN 0.5E0 ELSE 0.5E0 + 0.28E0 * least((id * 37 % 400000 - 30000) / 270000.0E0, 1) END AS t""")
scalar("mth08_mired", lambda: {"m": numbers.mired(c("iso") * 10)}, "CASE WHEN iso > 0 THEN 1000000.0E0 / (iso * 10) END AS m")


def _box(x: int, y: int) -> Column:
    return F.struct((c("vec_id") % x / 10).alias("x"), (c("vec_id") % y / 10).alias("y"), F.lit(0.3).alias("width"), F.lit(0.25).alias("height"))


scalar("mth11_iou", lambda: {"iou": numbers.iou(_box(7, 5), _box(4, 3))}, """
    greatest(0.3E0 - abs(vec_id % 7 / 10.0E0 - vec_id % 4 / 10.0E0), 0) * greatest(0.25E0 - abs(vec_id % 5 / 10.0E0 - vec_id % 3 / 10.0E0), 0)
      / (0.15E0 - greatest(0.3E0 - abs(vec_id % 7 / 10.0E0 - vec_id % 4 / 10.0E0), 0) * greatest(0.25E0 - abs(vec_id % 5 / 10.0E0 - vec_id % 3 / 10.0E0), 0)) AS iou""", "vectors", "vec_id")
scalar("mth09_prominence", lambda: {"p": numbers.prominence(_box(7, 5))}, """
    0.25E0 * (1 - least(sqrt(pow(vec_id % 7 / 10.0E0 + 0.15E0 - 0.5E0, 2) + pow(vec_id % 5 / 10.0E0 + 0.125E0 - 0.5E0, 2)) / 0.75E0, 1) * 0.5E0) AS p""", "vectors", "vec_id")
scalar("mth04_cosine", lambda: {"c": F.round(numbers.cosine(c("embedding"), F.reverse("embedding")), 6), "n": F.round(numbers.norm(numbers.normalize(c("embedding"))), 6)}, """
    round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS c, 1.0E0 AS n""", "vectors", "vec_id")


@register("mth05_scene_similarity", oracle("""
    WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) / list_sum(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE))))) AS p FROM {vectors})
    SELECT a.vec_id, round(0.7E0 * list_sum(list_transform(list_zip(a.p, b.p), lambda z: sqrt(z[1] * z[2]))) + 0.3E0 * exp(-pow((a.vec_id % 5 - b.vec_id % 5) / 2.0E0, 2) - pow(0.01E0 * (a.vec_id % 3 - b.vec_id % 3) / 0.08E0, 2)), 6) AS similarity
    FROM h a JOIN h b ON b.vec_id = a.vec_id + 1"""))
def mth05_scene_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    share = F.transform("embedding", lambda x: F.abs(x.cast("double")) / size)
    light = F.struct(share.alias("luma"), share.alias("ab"), (c("vec_id") % 5).cast("double").alias("ev"), F.array(c("vec_id") % 3 * 0.01, F.lit(0.0)).alias("tint"))
    rows = view(spark, sf_dir, "vectors").select("vec_id", light.alias("light"))
    after = rows.select((c("vec_id") - 1).alias("vec_id"), c("light").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(numbers.scene_similarity(c("light"), c("next")), 6).alias("similarity"))


@register("mth10_colour_difference", oracle("""
    WITH x AS (SELECT range AS r FROM range(256))
    SELECT r, CASE WHEN r / 255.0E0 <= 0.04045E0 THEN r / 255.0E0 / 12.92E0 ELSE pow((r / 255.0E0 + 0.055E0) / 1.055E0, 2.4E0) END AS y,
           round(CASE WHEN y > 216 / 24389.0E0 THEN 116 * pow(y, 1 / 3.0E0) - 16 ELSE 24389 / 27.0E0 * y END, 3) AS lightness FROM x"""))
def mth10_colour_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greys: linear light, and CIE lightness by way of Lab."""
    v = c("id") / 255
    grey = spark.range(256).select("id", numbers.lab(v, v, v).alias("lab"), numbers.linear(v).alias("y"))
    return grey.select(c("id").alias("r"), "y", F.round("lab.l", 3).alias("lightness"))


@register("jsn02_json_edit", oracle("""
    SELECT image_id, CAST(json_extract(params_json, '$.exposure') AS BIGINT) AS exposure, json_type(params_json, '$.light') = 'OBJECT' AS nested, json_valid(params_json) AS valid,
           json_extract(json_merge_patch(params_json, '{"exposure":9}'), '$.exposure') = '9' AS put FROM {adjustments}"""))
def jsn02_json_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("params_json")
    kind = F.schema_of_variant(F.variant_get(v, "$.light", "variant"))
    changed = F.map_concat(F.map_filter(F.from_json("params_json", "map<string,string>"), lambda k, _: k != "exposure"), F.create_map(F.lit("exposure"), F.lit("9")))
    return view(spark, sf_dir, "adjustments").select("image_id", F.try_variant_get(v, "$.exposure", "bigint").alias("exposure"), kind.startswith("OBJECT").alias("nested"), v.isNotNull().alias("valid"), (changed["exposure"] == "9").alias("put"))


@register("jsn03_deep_merge", oracle("""
    SELECT image_id, CAST(m->>'$.exposure' AS BIGINT) AS exposure, CAST(m->>'$.light.contrast' AS BIGINT) AS contrast, CAST(m->>'$.light.shadows' AS BIGINT) AS shadows, CAST(m->>'$.grain' AS BIGINT) AS grain
    FROM (SELECT image_id, json_merge_patch('{"exposure":0,"light":{"contrast":1,"shadows":7},"grain":3}', params_json) AS m FROM {adjustments})"""))
def jsn03_deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlay over nested defaults: its known values win, at any depth."""
    v = F.try_parse_json("params_json")
    over = lambda path, default: F.coalesce(F.try_variant_get(v, path, "bigint"), F.lit(default).cast("bigint"))
    return view(spark, sf_dir, "adjustments").select("image_id", over("$.exposure", 0).alias("exposure"), over("$.light.contrast", 1).alias("contrast"), over("$.light.shadows", 7).alias("shadows"), over("$.grain", 3).alias("grain"))


@register("jsn04_parse_or_default", oracle("""
    SELECT image_id, CASE WHEN json_valid(reasons_json) THEN CAST(json_array_length(reasons_json) AS INTEGER) ELSE 0 END AS n FROM {scores}"""))
def jsn04_parse_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("reasons_json", "array<struct<kind:string,text:string>>")
    return view(spark, sf_dir, "scores").select("image_id", F.when(F.try_parse_json("reasons_json").isNotNull(), F.size(parsed)).otherwise(0).alias("n"))


@register("srt09_reason_order", oracle("""
    SELECT image_id, CASE WHEN image_id % 8 = 0 THEN 'blink' WHEN image_id % 8 = 1 THEN 'missed_focus,other' ELSE '' END AS kinds FROM {scores}"""))
def srt09_reason_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by rank, in their order where ranks are equal."""
    parsed = F.coalesce(F.from_json("reasons_json", "array<struct<kind:string,text:string>>"), F.array().cast("array<struct<kind:string,text:string>>"))
    rank = lambda k: F.when(k == "missed_focus", 0).when(k == "motion_blur", 1).when(k == "blink", 2).otherwise(9)
    placed = F.array_sort(F.transform(F.filter(parsed, lambda r: r["kind"].isNotNull()), lambda r, i: F.struct(rank(r["kind"]).alias("rank"), i.alias("at"), r["kind"].alias("kind"))))
    return view(spark, sf_dir, "scores").select("image_id", F.array_join(F.transform(placed, lambda r: r["kind"]), ",").alias("kinds"))


@register("arr01_arrays", oracle("""
    WITH t AS (SELECT image_id, list(tag ORDER BY tag) AS tags FROM {tags} GROUP BY image_id)
    SELECT image_id, list_position(tags, 't3') AS place, list_contains(tags, 't1') AS has, array_to_string(tags[1:2], ',') AS two, CAST(len(list_distinct(list_transform(tags, lambda x: substring(x, 1, 1)))) AS INTEGER) AS kinds FROM t"""))
def arr01_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "tags").groupBy("image_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    place = F.nullif(F.array_position("tags", "t3"), F.lit(0).cast("bigint")).cast("int")
    return t.select("image_id", place.alias("place"), F.array_contains("tags", "t1").alias("has"), F.array_join(F.slice("tags", 1, 2), ",").alias("two"), F.size(F.array_distinct(F.transform("tags", lambda x: F.substring(x, 1, 1)))).alias("kinds"))


@register("arr02_nested_faces", oracle("""
    SELECT image_id, max(confidence) AS most, min(confidence) AS least, avg(CAST(confidence AS DOUBLE)) AS mean, count(*) FILTER (confidence >= 0.05) AS good FROM {tags} GROUP BY image_id"""))
def arr02_nested_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image over its nested values, by higher-order functions."""
    nested = view(spark, sf_dir, "tags").groupBy("image_id").agg(F.collect_list("confidence").alias("f"))
    mean = F.aggregate("f", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("f")
    return nested.select("image_id", F.array_max("f").alias("most"), F.array_min("f").alias("least"), mean.alias("mean"), F.size(F.filter("f", lambda x: x >= 0.05)).cast("long").alias("good"))


@register("prj01_entries", oracle("""
    SELECT i.id, i.file_name, s.overall, s.face_sharpness, coalesce(a.edited, FALSE) AS edited, coalesce(t.n, 0) AS tags, CASE WHEN i.missing_since_ms IS NOT NULL THEN 'missing' WHEN s.image_id IS NULL THEN 'pending' ELSE 'ready' END AS state
    FROM {images} i LEFT JOIN {scores} s ON s.image_id = i.id LEFT JOIN (SELECT image_id, bool_or(NOT neutral) AS edited FROM {adjustments} GROUP BY image_id) a ON a.image_id = i.id
    LEFT JOIN (SELECT image_id, count(*) AS n FROM {tags} GROUP BY image_id) t ON t.image_id = i.id"""))
def prj01_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide rows; state is the tag of a union of ready, pending and missing."""
    wide = query.entries(tables(spark, sf_dir))
    state = F.when(c("missing_since_ms").isNotNull(), "missing").when(c("quality").isNull(), "pending").otherwise("ready")
    return wide.select("id", "file_name", "quality.overall", "quality.face_sharpness", "edited", F.coalesce(F.size("tags"), F.lit(0)).cast("long").alias("tags"), state.alias("state"))


_PAGE = CatalogQuery(picks=["pick"], min_rating=1, sort="quality", offset=3, limit=50)


@register("srt02_page_of_wide_rows", oracle("""
    WITH f AS (SELECT i.id, i.file_name, s.overall FROM {images} i LEFT JOIN {scores} s ON s.image_id = i.id WHERE pick = 'pick' AND rating >= 1),
    r AS (SELECT *, row_number() OVER (ORDER BY overall DESC NULLS LAST, id) AS pos, count(*) OVER () AS total FROM f)
    SELECT pos, id, file_name, total FROM r WHERE pos BETWEEN 4 AND 53"""))
def srt02_page_of_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is found over narrow rows; wide rows and the total join it afterwards."""
    tab = tables(spark, sf_dir)
    total = query.filtered(tab, _PAGE).agg(F.count(F.lit(1)).alias("total"))
    return query.page(tab, _PAGE).join(F.broadcast(total)).select(c("pos").cast("long").alias("pos"), "id", "file_name", "total")  # one row


@register("jon19_by_id_list", oracle("SELECT pos, id, file_name FROM (SELECT unnest([64, 5, 1, 999999999, 7]) AS id, unnest([0, 1, 2, 3, 4]) AS pos) JOIN {images} USING (id)"))
def jon19_by_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a list of ids; one that isn't there is left out."""
    return query.by_ids(tables(spark, sf_dir), [64, 5, 1, 999_999_999, 7]).select("pos", "id", "file_name")


@register("win11_thinned_holdout", oracle("""
    WITH r AS (SELECT id, trim(lens) AS lens, row_number() OVER (PARTITION BY trim(lens) ORDER BY captured_at_ms, id) AS r, count(*) OVER (PARTITION BY trim(lens)) AS n FROM {images} WHERE nullif(trim(lens), '') IS NOT NULL AND captured_at_ms IS NOT NULL),
    h AS (SELECT *, n // 5 AS held, r - (n - n // 5) - 1 AS k FROM r WHERE n >= 25 AND r > n - n // 5)
    SELECT id, lens FROM h WHERE held <= 40 OR (k * 40) // held <> ((k - 1) * 40) // held OR k = 0"""))
def win11_thinned_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each lens's last fifth in time, forty evenly spaced rows; only where 5 are held out and 20 stay."""
    rows = view(spark, sf_dir, "images").select("id", text.known(c("lens")).alias("lens"), "captured_at_ms").filter("lens IS NOT NULL AND captured_at_ms IS NOT NULL")
    w = Window.partitionBy("lens")
    held = F.floor(c("n") / 5)
    rows = rows.withColumn("r", F.row_number().over(w.orderBy("captured_at_ms", "id"))).withColumn("n", F.count(F.lit(1)).over(w)).filter((c("n") >= 25) & (c("r") > c("n") - held))
    k = c("r") - (c("n") - held) - 1
    return rows.filter((held <= 40) | (k == 0) | (F.floor(k * 40 / held) != F.floor((k - 1) * 40 / held))).select("id", "lens")


@register("grp01_catalog_bursts", oracle("""
    WITH t AS (SELECT i.id, i.folder_id, captured_at_ms AS t, phash, q.overall FROM {images} i LEFT JOIN {scores} q ON q.image_id = i.id WHERE captured_at_ms IS NOT NULL),
    x AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 15000 OR coalesce(bit_count(xor(phash, lag(phash) OVER w)) > 16, FALSE) THEN 1 ELSE 0 END AS cut FROM t WINDOW w AS (PARTITION BY folder_id ORDER BY t, id)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY folder_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS b FROM x),
    s AS (SELECT *, count(*) OVER (PARTITION BY folder_id, b) AS n, row_number() OVER (PARTITION BY folder_id, b ORDER BY overall DESC NULLS LAST, t, id) AS k, row_number() OVER (PARTITION BY folder_id, b ORDER BY t, id) AS pos FROM g)
    SELECT id, folder_id, n, pos, k = 1 AS is_keeper FROM s WHERE n > 1"""))
def grp01_catalog_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a folder close in time whose hashes differ in at most sixteen bits from the frame before."""
    scores = view(spark, sf_dir, "scores").select(c("image_id").alias("id"), "overall")
    rows = view(spark, sf_dir, "images").select("id", "folder_id", "captured_at_ms", "phash").join(scores, "id", "left")
    w = Window.partitionBy("folder_id").orderBy("captured_at_ms", "id")
    unlike = F.coalesce(numbers.hamming(c("phash"), F.lag("phash").over(w)) > 16, F.lit(False))
    found = sequence.bursts(rows, "folder_id", "captured_at_ms", "id", "overall", 15_000, unlike)
    return found.select("id", "folder_id", c("burst_size").alias("n"), c("burst_pos").cast("long").alias("pos"), "is_keeper")


@register("lrn01_standardized", oracle("""
    WITH f AS (SELECT camera_make, list_sort(list(focal_mm))[len(list(focal_mm)) // 2 + 1] AS fill FROM {images} WHERE focal_mm IS NOT NULL GROUP BY camera_make),
    x AS (SELECT i.id, i.camera_make, coalesce(i.focal_mm, f.fill) AS v FROM {images} i JOIN f ON f.camera_make = i.camera_make), m AS (SELECT camera_make, avg(v) AS mean, var_pop(v) AS var FROM x GROUP BY camera_make)
    SELECT x.id, round((v - mean) / CASE WHEN var > 1E-12 THEN sqrt(var) ELSE 1 END, 6) AS z FROM x JOIN m ON m.camera_make = x.camera_make"""))
def lrn01_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values take the upper median of their group; then zero mean and unit deviation. Counts of distinct values stand for a sort of all rows."""
    rows = view(spark, sf_dir, "images").select("id", "camera_make", "focal_mm")
    counts = rows.filter("focal_mm IS NOT NULL").groupBy("camera_make", "focal_mm").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("camera_make")
    placed = counts.withColumn("to", F.sum("n").over(w.orderBy("focal_mm"))).withColumn("half", F.floor(F.sum("n").over(w) / 2))
    fill = placed.filter("to > half").groupBy("camera_make").agg(F.min("focal_mm").alias("fill"))
    x = rows.join(F.broadcast(fill), "camera_make").withColumn("v", F.coalesce("focal_mm", "fill"))  # a row for each make
    m = x.groupBy("camera_make").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    z = (c("v") - c("mean")) / F.when(c("var") > 1e-12, F.sqrt("var")).otherwise(1.0)
    return x.join(F.broadcast(m), "camera_make").select("id", F.round(z, 6).alias("z"))


scalar("scr02_components", lambda: {"sharp": scoring.sharpness(c("face_sharpness"), 0.4), "open": scoring.openness(c("eyes_open"), 0.3)}, """
    CASE WHEN face_sharpness IS NOT NULL THEN least(greatest((face_sharpness - 0.25E0) / 0.45E0, 0), 1) END AS sharp, CASE WHEN eyes_open IS NOT NULL THEN least(greatest((eyes_open - 0.15E0) / 0.33E0, 0), 1) END AS open""", "scores", "image_id")


@register("scr01_stars_and_caps", oracle("""
    WITH m AS (SELECT image_id, (0.5E0 * coalesce(least(greatest((face_sharpness - 0.25E0) / 0.45E0, 0), 1), 0) + 0.3E0 * coalesce(eyes_open, 0) + 0.2E0 * coalesce(composition, 0))
        / nullif(CASE WHEN face_sharpness IS NULL THEN 0 ELSE 0.5E0 END + CASE WHEN eyes_open IS NULL THEN 0 ELSE 0.3E0 END + CASE WHEN composition IS NULL THEN 0 ELSE 0.2E0 END, 0) AS raw,
        coalesce(reasons_json LIKE '%"missed_focus"%', FALSE) AS soft, coalesce(reasons_json LIKE '%"blink"%', FALSE) AS blink FROM {scores}),
    o AS (SELECT *, CASE WHEN soft THEN least(coalesce(raw, 0), 0.35E0) WHEN blink THEN least(coalesce(raw, 0), 0.4E0) ELSE coalesce(raw, 0) END AS overall FROM m)
    SELECT image_id, round(overall, 9) AS overall, CAST(least(1 + CASE WHEN overall >= 0.5E0 THEN 1 ELSE 0 END + CASE WHEN overall >= 0.65E0 THEN 1 ELSE 0 END + CASE WHEN overall >= 0.78E0 THEN 1 ELSE 0 END + CASE WHEN overall >= 0.88E0 THEN 1 ELSE 0 END,
           CASE WHEN blink THEN 2 WHEN soft THEN 3 ELSE 5 END) AS INTEGER) AS stars,
           CASE WHEN soft OR blink OR overall < 0.2E0 THEN 'reject' WHEN overall >= 0.65E0 THEN 'pick' ELSE 'unflagged' END AS pick FROM o"""))
def scr01_stars_and_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft, blink = F.coalesce(c("reasons_json").contains('"missed_focus"'), F.lit(False)), F.coalesce(c("reasons_json").contains('"blink"'), F.lit(False))
    raw = scoring.weighted((0.5, scoring.sharpness(c("face_sharpness"), 0.4)), (0.3, c("eyes_open")), (0.2, c("composition")))
    rows = view(spark, sf_dir, "scores").select("image_id", scoring.capped(raw, soft, blink).alias("overall"), soft.alias("soft"), blink.alias("blink"))
    return rows.select("image_id", F.round("overall", 9).alias("overall"), scoring.stars(c("overall"), c("soft"), c("blink")).alias("stars"), scoring.flag(c("overall"), c("soft") | c("blink"), 0.2, 0.65).alias("pick"))


@register("agg05_all_facets", oracle("""
    WITH f AS (SELECT i.*, EXISTS (SELECT 1 FROM {adjustments} a WHERE a.image_id = i.id AND NOT a.neutral) AS edited FROM {images} i WHERE rating >= 3)
    SELECT 'format' AS facet, format AS value, count(*) AS n FROM f GROUP BY format UNION ALL SELECT 'extension', CASE WHEN instr(file_name, '.') = 0 THEN '' ELSE lower(regexp_extract(file_name, '[^.]*$')) END, count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'camera', concat_ws(' ', camera_make, nullif(trim(camera_model), '')), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'body', concat_ws(' ', camera_make, nullif(trim(camera_model), ''), coalesce(nullif(trim(camera_serial), ''), '?')), count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'lens', nullif(trim(lens), ''), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'iso', CAST(iso AS VARCHAR), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'focal', CAST(round(focal_mm, 1) AS VARCHAR), count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'aperture', CAST(round(aperture, 1) AS VARCHAR), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'shutter', CAST(CAST(round(1 / shutter_s) AS BIGINT) AS VARCHAR), count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'captured', CAST(captured_at_ms - captured_at_ms % 86400000 AS VARCHAR), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'edited', CASE WHEN edited THEN 'true' ELSE 'false' END, count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'sidecar', CASE WHEN xmp_mtime_ms IS NOT NULL THEN 'true' ELSE 'false' END, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM f"""))
def agg05_all_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve facets and the total, from one filtered scan."""
    tab, q = tables(spark, sf_dir), CatalogQuery(min_rating=3)
    total = query.filtered(tab, q).agg(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("n"))
    return query.facet_counts(tab, q).unionByName(total)


@register("str10_claimed_names", oracle("""
    WITH x AS (SELECT id, folder_id, concat('img-', CAST(id % 40 AS VARCHAR)) AS name FROM {images} WHERE folder_id < 3 AND id % 11 < 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY folder_id, name ORDER BY id) AS r FROM x)
    SELECT count(DISTINCT (folder_id, name, r)) AS files, count(*) FILTER (r = 1) AS plain FROM r"""))
def str10_claimed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file gets a name of its own; tests hold the names against the rule one by one."""
    rows = view(spark, sf_dir, "images").filter("folder_id < 3 AND id % 11 < 3").select("id", "folder_id", F.concat(F.lit("img-"), (c("id") % 40).cast("string")).alias("name"), F.lit("jpg").alias("ext"))
    done = text.claim_names(rows, "folder_id", "name", "ext", [c("id")])
    return done.agg(F.countDistinct("folder_id", F.lower("claimed")).alias("files"), F.count_if(c("claimed") == F.concat("name", F.lit(".jpg"))).alias("plain"))
