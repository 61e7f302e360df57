"""The catalog query: filters, sort and page over a narrow plan; wide rows are joined back for the page alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.numbers import day_of
from shutterlake.functions.text import extension, known
from shutterlake.operators import predicates as p

MAX_PAGE = 1000
FORMATS = ["arw", "raf", "cr3", "jpeg", "heic", "tiff", "png"]


@dataclass
class Catalog:
    """The tables that a query reads."""

    images: DataFrame
    scores: DataFrame
    tags: DataFrame
    bursts: DataFrame
    adjustments: DataFrame
    selection: DataFrame


@dataclass(frozen=True)
class CatalogQuery:
    """Filters are ANDed; what isn't set doesn't constrain."""

    folder_ids: Sequence[int] | None = None
    picks: Sequence[str] = ()
    colors: Sequence[str] = ()
    formats: Sequence[str] = ()
    extensions: Sequence[str] = ()
    min_rating: int | None = None
    max_rating: int | None = None
    tags: Sequence[str] = ()
    tag_match: str = "any"
    exclude_tags: Sequence[str] = ()
    pick_origin: str | None = None
    cameras: Sequence[tuple] = ()
    lenses: Sequence[str | None] = ()
    iso: tuple = (None, None)
    shutter: tuple = (None, None)
    aperture: tuple = (None, None)
    focal: tuple = (None, None)
    captured: tuple = (None, None)
    days: Sequence[int | None] = ()
    edited: bool | None = None
    sidecar: bool | None = None
    missing_only: bool = False
    collapse_bursts: bool = False
    keeper_rule: str | None = None
    keeper_min_rating: int = 1
    keeper_suggestions: bool = False
    suggested: Sequence[str] = ()
    reason_kinds: Sequence[str] = ()
    piles: Sequence[str] = ()
    choices: Sequence[str] = ()
    text: str | None = None
    sort: str = "capture_time"
    descending: bool = False
    offset: int = 0
    limit: int = 100

    def without(self, *names: str) -> CatalogQuery:
        """The same query without some of its constraints."""
        default = {f.name: f.default for f in fields(self)}
        return replace(self, **{n: default[n] for n in names})


def filtered(c: Catalog, q: CatalogQuery) -> DataFrame:
    """The images that match. Joins are added only for the constraints that need them."""
    df, col = c.images, F.col
    if q.suggested or q.reason_kinds or q.piles or q.keeper_rule:
        df = df.join(c.scores.select(col("image_id").alias("id"), "overall", "suggested_pick", "suggested_rating", "reasons_json"), "id", "left")
    if q.piles:
        df = df.join(c.selection.select(col("image_id").alias("id"), "choice", "covered_by", "covered_similarity", col("reasons_json").alias("why")), "id")
    parts: list[Column] = [
        p.scope(col("folder_id"), q.folder_ids),
        p.one_of(col("pick"), q.picks),
        p.one_of(col("color_label"), q.colors),
        p.one_of(col("format"), q.formats),
        p.stars(col("rating"), q.min_rating, q.max_rating),
        p.flag_origin(col("pick"), col("pick_origin"), q.pick_origin),
        p.any_camera(q.cameras, col("camera_make"), col("camera_model"), col("camera_serial")),
        p.one_of(known(col("lens")), q.lenses),
        p.near_range(col("iso"), *q.iso),
        p.near_range(col("shutter_s"), *q.shutter),
        p.near_range(col("aperture"), *q.aperture, digits=1),
        p.near_range(col("focal_mm"), *q.focal, digits=1),
        p.from_until(col("captured_at_ms"), *q.captured),
        p.one_of(day_of(col("captured_at_ms")), q.days),
    ]
    if q.extensions:
        parts.append(extension(col("file_name")).isin(list(q.extensions)))
    if q.sidecar is not None:
        parts.append(col("xmp_mtime_ms").isNotNull() if q.sidecar else col("xmp_mtime_ms").isNull())
    if q.missing_only:
        parts.append(col("missing_since_ms").isNotNull())
    if q.text:
        parts.append(F.lower("file_name").contains(q.text.lower()))
    if q.suggested:
        parts.append(p.pending(q.suggested, col("pick"), col("rating"), col("suggested_pick"), col("suggested_rating")))
    if q.reason_kinds:
        parts.append(p.first_kind(col("reasons_json")).isin(list(q.reason_kinds)))
    if q.piles:
        parts.append(p.pile(col("choice"), col("pick"), col("suggested_pick"), col("why"), col("covered_by"), col("covered_similarity")).isin(list(q.piles)))
    if q.keeper_rule:
        parts.append(p.keeper(q.keeper_rule, col("pick"), col("rating"), col("suggested_pick"), q.keeper_min_rating, q.keeper_suggestions))
    df = df.filter(p.all_of(parts))
    df = p.with_tags(df, c.tags, q.tags, q.tag_match)
    df = p.with_tags(df, c.tags, q.exclude_tags, "none")
    if q.edited is not None:
        done = c.adjustments.filter("NOT neutral").select(col("image_id").alias("id"))
        df = df.join(done, "id", "left_semi" if q.edited else "left_anti")
    if q.choices:
        df = df.join(c.selection.filter(col("choice").isin(list(q.choices))).select(col("image_id").alias("id")), "id", "left_semi")
    if q.collapse_bursts:
        df = p.collapse_bursts(df, c.bursts)
    return df.select(*c.images.columns)


def sort_key(sort: str, descending: bool) -> list[Column]:
    """Every order ends in the id; capture time and quality have null last both ways."""
    col = F.col
    up = [col("captured_at_ms").asc_nulls_last(), col("file_name").asc(), col("id").asc()]
    down = [col("captured_at_ms").desc_nulls_last(), col("file_name").desc(), col("id").desc()]
    if sort == "capture_time":
        return down if descending else up
    if sort == "file_name":
        return [col("file_name").desc(), col("id").desc()] if descending else [col("file_name"), col("id")]
    if sort == "quality":
        return [col("overall").asc_nulls_last(), col("id").desc()] if descending else [col("overall").desc_nulls_last(), col("id")]
    if sort == "rating":
        return [col("rating").asc() if descending else col("rating").desc(), *up]
    if sort == "target_moment":
        key = [col("moment_id").isNull(), col("moment_start").asc_nulls_last(), col("moment_id")]
        if descending:
            key = [col("moment_id").isNull(), col("moment_start").desc_nulls_first(), col("moment_id").desc()]
        return [*key, col("score").desc_nulls_last(), *up]
    raise p.InvalidArgument(f"no sort {sort}")


def sortable(c: Catalog, df: DataFrame, sort: str) -> DataFrame:
    """The narrow columns that the sort needs, joined only if it does."""
    base = df.select("id", "captured_at_ms", "file_name", "rating")
    if sort == "quality":
        return base.join(c.scores.select(F.col("image_id").alias("id"), "overall"), "id", "left")
    if sort == "target_moment":
        starts = c.selection.join(c.images.select(F.col("id").alias("image_id"), "captured_at_ms"), "image_id").groupBy("moment_id").agg(F.min("captured_at_ms").alias("moment_start"))
        mine = c.selection.select(F.col("image_id").alias("id"), "moment_id", "score")
        return base.join(mine, "id", "left").join(starts, "moment_id", "left")
    return base


def page_ids(c: Catalog, q: CatalogQuery) -> DataFrame:
    """(pos, id) of the page. Only the offset and limit rows at the front are kept while sorting."""
    if q.offset < 0 or not 0 < q.limit <= MAX_PAGE:
        raise p.InvalidArgument("a page has 1 to 1000 rows")
    key = sort_key(q.sort, q.descending)
    first = sortable(c, filtered(c, q), q.sort).orderBy(*key).offset(q.offset).limit(q.limit)
    return number_page(first, key, q.offset).select("pos", "id")


def number_page(page: DataFrame, key: list[Column], offset: int) -> DataFrame:
    from pyspark.sql import Window

    return page.withColumn("pos", F.row_number().over(Window.orderBy(*key)) + offset)  # a page is 1000 rows at most


def page(c: Catalog, q: CatalogQuery) -> DataFrame:
    """The page's wide rows, with pos; late, so that sorting moves narrow rows."""
    return F.broadcast(page_ids(c, q)).join(entries(c), "id")  # a page is 1000 rows at most


def by_ids(c: Catalog, ids: Sequence[int], strict: bool = False) -> DataFrame:
    """The wide rows of the ids in their order, with pos; strict fails if one isn't there."""
    spark = c.images.sparkSession
    wanted = spark.createDataFrame([(list(ids),)], "ids array<long>").select(F.posexplode("ids").alias("pos", "id"))
    found = F.broadcast(wanted).join(entries(c), "id")  # as long as the request
    if strict and (gone := wanted.join(c.images, "id", "left_anti").select("id").take(1)):
        raise NotFound(f"no image {gone[0][0]}")
    return found


NotFound = p.NotFound


def entries(c: Catalog) -> DataFrame:
    """An image with its nested quality, tags in order, and flags."""
    tags = c.tags.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("tag", "source", "confidence", "suppressed"))).alias("tags"))
    edits = c.adjustments.groupBy("image_id").agg(F.bool_or(~F.col("neutral")).alias("edited"))
    scores = c.scores.select("image_id", F.struct("overall", "face_sharpness", "eyes_open", "suggested_pick").alias("quality"), F.coalesce(F.from_json("reasons_json", "array<struct<kind:string,text:string>>"), F.array().cast("array<struct<kind:string,text:string>>")).alias("reasons"))
    out = c.images.withColumnRenamed("id", "image_id")
    for other in (scores, tags, edits):
        out = out.join(other, "image_id", "left")
    empty = F.array().cast("array<struct<kind:string,text:string>>")
    return out.withColumn("edited", F.coalesce("edited", F.lit(False))).withColumn("reasons", F.coalesce("reasons", empty)).withColumnRenamed("image_id", "id")


#: Facet: (constraints of the query that it leaves out, its value).
FACETS: dict[str, tuple[tuple[str, ...], Column]] = {}


def _facets() -> dict[str, tuple[tuple[str, ...], Column]]:
    col, text = F.col, lambda x: x.cast("string")
    return {
        "format": (("formats",), col("format")),
        "extension": (("extensions",), extension(col("file_name"))),
        "camera": (("cameras",), F.concat_ws(" ", col("camera_make"), known(col("camera_model")))),
        "body": (("cameras",), F.concat_ws(" ", col("camera_make"), known(col("camera_model")), F.coalesce(known(col("camera_serial")), F.lit("?")))),
        "lens": (("lenses",), known(col("lens"))),
        "iso": (("iso",), text(col("iso"))),
        "focal": (("focal",), text(F.round("focal_mm", 1))),
        "aperture": (("aperture",), text(F.round("aperture", 1))),
        "shutter": (("shutter",), text(F.round(1 / col("shutter_s")).cast("long"))),
        "captured": (("captured", "days"), text(day_of(col("captured_at_ms")))),
        "edited": (("edited",), text(col("__edited"))),
        "sidecar": (("sidecar",), text(col("xmp_mtime_ms").isNotNull())),
    }


def facet_counts(c: Catalog, q: CatalogQuery, names: Sequence[str] | None = None) -> DataFrame:
    """(facet, value, n): per facet, images by value under all constraints but the facet's own; unknown is null.

    Facets whose own constraints aren't set share one filtered scan: each of its rows gives one row per such facet to a
    partial aggregate. Every facet with a constraint of its own adds one scan.
    """
    known_facets = _facets()
    names = list(names or known_facets)
    default = CatalogQuery()
    free = [n for n in names if all(getattr(q, f) == getattr(default, f) for f in known_facets[n][0])]
    edited = c.adjustments.filter("NOT neutral").select(F.col("image_id").alias("id"), F.lit(True).alias("__e"))

    def count(query: CatalogQuery, some: list[str]) -> DataFrame:
        df = filtered(c, query)
        if "edited" in some:
            df = df.join(edited.distinct(), "id", "left").withColumn("__edited", F.coalesce("__e", F.lit(False)))
        pairs = F.array(*[F.struct(F.lit(n).alias("facet"), known_facets[n][1].alias("value")) for n in some])
        return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))

    parts = ([count(q, free)] if free else []) + [count(q.without(*known_facets[n][0]), [n]) for n in names if n not in free]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
