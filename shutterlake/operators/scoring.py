"""Parts of the quality score, as Columns. Weights, caps and cuts are those that the score is defined by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.numbers import clamp

# A star for each cut passed, and what a defect leaves of a score.
STAR_CUTS = (0.5, 0.65, 0.78, 0.88)
SOFT_CAP, BLINK_CAP, SOFT_STARS, BLINK_STARS = 0.35, 0.4, 3, 2


def sharpness(value: Column, least: float) -> Column:
    """0 at .15 below the least sharpness that passes, 1 at .3 above it; null if unknown."""
    return F.when(value.isNotNull(), clamp((value - (least - 0.15)) / 0.45, 0.0, 1.0))


def openness(value: Column, blink: float) -> Column:
    """0 at half the value of a blink, 1 at 1.6 times it; null if unknown."""
    return F.when(value.isNotNull(), clamp((value - 0.5 * blink) / (1.1 * blink), 0.0, 1.0))


def weighted(*parts: tuple[float, Column]) -> Column:
    """The weighted mean of the parts that are known; 0 if none is."""
    weight = sum((F.when(x.isNull(), F.lit(0.0)).otherwise(F.lit(w)) for w, x in parts), F.lit(0.0))
    value = sum((F.coalesce(x * w, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    return F.coalesce(value / F.nullif(weight, F.lit(0.0)), F.lit(0.0))


def capped(overall: Column, soft: Column, blink: Column) -> Column:
    return F.when(soft, F.least(overall, F.lit(SOFT_CAP))).when(blink, F.least(overall, F.lit(BLINK_CAP))).otherwise(overall)


def stars(overall: Column, soft: Column, blink: Column) -> Column:
    passed = sum((F.when(overall >= x, 1).otherwise(0) for x in STAR_CUTS), F.lit(1))
    return F.least(passed, F.when(blink, BLINK_STARS).when(soft, SOFT_STARS).otherwise(5))


def flag(overall: Column, defect: Column, low: float, pick: float) -> Column:
    return F.when(defect | (overall < low), "reject").when(overall >= pick, "pick").otherwise("unflagged")
