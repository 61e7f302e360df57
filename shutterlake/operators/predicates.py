"""Predicates of the catalog query, as Columns; an empty list or None is no constraint."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.text import known

TOLERANCE = 1e-6


class InvalidArgument(ValueError):
    """A request that no plan is made for."""


class NotFound(LookupError):
    """An id that isn't there."""


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def one_of(col: Column, values: Sequence | None) -> Column:
    """IN; a None among the values also accepts null."""
    if not values:
        return F.lit(True)
    some = [v for v in values if v is not None]
    got = col.isin(some) if some else F.lit(False)
    return got | col.isNull() if len(some) < len(values) else got


def stars(col: Column, low: int | None, high: int | None) -> Column:
    for v in (low, high):
        if v is not None and not 0 <= v <= 5:
            raise InvalidArgument(f"rating {v} is outside 0 to 5")
    return all_of([c for c in (col >= low if low is not None else None, col <= high if high is not None else None) if c is not None])


def near_range(col: Column, low: float | None, high: float | None, digits: int | None = None) -> Column:
    """Inclusive, with bounds widened by a millionth; null never matches. digits rounds the column first."""
    for v in (low, high):
        if v is not None and not math.isfinite(v):
            raise InvalidArgument("a bound isn't finite")
    if low is None and high is None:
        return F.lit(True)
    x = F.round(col, digits) if digits is not None else col
    parts = [x.isNotNull()]
    if low is not None:
        parts.append(x >= low - abs(low) * TOLERANCE)
    if high is not None:
        parts.append(x <= high + abs(high) * TOLERANCE)
    return all_of(parts)


def from_until(col: Column, start, end) -> Column:
    return all_of([c for c in (col >= start if start is not None else None, col < end if end is not None else None) if c is not None])


def flag_origin(pick: Column, origin: Column, wanted: str | None) -> Column:
    """Flagged by the machine or by the user; an unknown origin is the user's."""
    if wanted is None:
        return F.lit(True)
    auto = origin.eqNullSafe(F.lit("auto"))
    return (pick != "unflagged") & (auto if wanted == "auto" else ~auto)


def keeper(rule: str, pick: Column, rating: Column, suggested: Column, min_rating: int = 1, use_suggestions: bool = False) -> Column:
    """`not_rejected`: any flag but reject. `chosen`: picked or, if not rejected, rated; unrated ones by suggestion on request."""
    if rule == "not_rejected":
        return pick != "reject"
    if rule == "chosen":
        wanted = rating >= min_rating
        if use_suggestions:
            wanted = wanted | ((rating == 0) & suggested.eqNullSafe(F.lit("pick")))
        return (pick == "pick") | ((pick != "reject") & wanted)
    raise InvalidArgument(f"no keeper rule {rule}")


def pending(kinds: Sequence[str], pick: Column, rating: Column, suggested: Column, stars_suggested: Column) -> Column:
    """Undecided photos with a suggestion of any of the kinds pick, reject and rating."""
    of = {"pick": suggested == "pick", "reject": suggested == "reject", "rating": ~suggested.isin("pick", "reject") & (stars_suggested > 0)}
    if gone := [k for k in kinds if k not in of]:
        raise InvalidArgument(f"no suggestion kind {gone[0]}")
    return (pick == "unflagged") & (rating == 0) & reduce(lambda a, b: a | b, [of[k] for k in kinds])


def any_camera(cameras: Sequence[tuple], make: Column, model: Column, serial: Column) -> Column:
    """Any of (make, model) or (make, model, serial); None stands for unknown, which blank values are."""
    parts = []
    for c in cameras:
        p = make.eqNullSafe(F.lit(c[0])) & known(model).eqNullSafe(F.lit(c[1]))
        parts.append(p & known(serial).eqNullSafe(F.lit(c[2])) if len(c) > 2 else p)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def scope(col: Column, ids: Sequence[int] | None) -> Column:
    """None is everything, an empty list nothing."""
    if ids is None:
        return F.lit(True)
    return F.lit(False) if not ids else (col == ids[0] if len(ids) == 1 else col.isin(list(ids)))


def first_kind(reasons: Column) -> Column:
    return F.when(F.try_parse_json(reasons).isNotNull(), F.get_json_object(reasons, "$[0].kind"))


def pile(choice: Column, pick: Column, suggested: Column, reasons: Column, covered_by: Column, similarity: Column) -> Column:
    """The second look's pile of a selected photo; null for what is delivered or an alternative."""
    bad = pick.eqNullSafe(F.lit("reject")) | suggested.eqNullSafe(F.lit("reject"))
    alike = F.coalesce(first_kind(reasons).isin("near_duplicate", "not_best_of_setup"), F.lit(False)) | (covered_by.isNotNull() & (similarity >= 0.7))
    return F.when(choice == "not_sure", "not_sure").when(choice != "set_aside", None).when(bad, "defects").when(alike, "similar").otherwise("weaker")


def overlay(choice: Column, scored: Column) -> Column:
    """The suggestion that counts: a delivered photo is picked, another choice takes a pick away, else the scorer's."""
    return F.when(choice == "deliver", "pick").when(choice.isNotNull() & (scored == "pick"), "unflagged").otherwise(scored)


def with_tags(df: DataFrame, tags: DataFrame, wanted: Sequence[str], match: str, key: str = "id") -> DataFrame:
    """Rows that have any, all or none of the tags; suppressed tags don't count."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return df
    seen = tags.filter(~F.col("suppressed") & F.col("tag").isin(wanted))
    if match == "all":
        seen = seen.groupBy("image_id").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") == len(wanted))
    return df.join(seen.select(F.col("image_id").alias(key)), key, "left_anti" if match == "none" else "left_semi")


def collapse_bursts(df: DataFrame, bursts: DataFrame) -> DataFrame:
    """Without members of a burst other than its keeper; bursts whose keeper isn't set show all.

    Whether a keeper is among the rows doesn't matter: other filters may have taken it out, and its burst stays hidden.
    """
    chosen = bursts.filter("keeper_id IS NOT NULL").select(F.col("id").alias("__burst"), F.col("keeper_id").alias("__keeper"))
    return df.join(chosen, (F.col("burst_id") == F.col("__burst")) & (F.col("id") != F.col("__keeper")), "left_anti")
