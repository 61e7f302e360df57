"""Numeric, time and similarity functions of the catalog, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def day_of(ms: Column) -> Column:
    """Start of the day, also before 1970."""
    return ms - F.pmod(ms, F.lit(DAY_MS))


def exif_ms(text: Column, subsec: Column | None = None) -> Column:
    """`YYYY:MM:DD hh:mm:ss` as milliseconds of naive wall clock; null if malformed or out of range."""
    good = F.regexp_extract(text, r"^\s*(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})", 0)
    ts = F.try_to_timestamp(F.regexp_replace(F.trim(good), r"^(\d{4}):(\d{2}):(\d{2})[ T]", "$1-$2-$3 "), F.lit("yyyy-MM-dd HH:mm:ss"))
    ms = F.unix_seconds(ts) * 1000
    if subsec is None:
        return ms
    digits = F.regexp_extract(F.coalesce(subsec, F.lit("")), r"^\s*(\d{1,3})", 1)
    return ms + F.when(digits == "", 0).otherwise(F.rpad(digits, 3, "0").cast("int"))


def zoned_ms(text: Column) -> Column:
    """ISO date and time as milliseconds: with a zone in UTC, without one as naive wall clock; null if malformed."""
    zone = F.regexp_extract(text, r"(Z|[+-]\d{2}:\d{2})$", 1)
    ts = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    hours, minutes = F.try_element_at(F.split(F.substring(zone, 2, 5), ":"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(F.substring(zone, 2, 5), ":"), F.lit(2)).try_cast("int")
    shift = F.when(zone.isin("", "Z"), 0).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
    return F.unix_millis(ts) - shift * 60_000


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ramp(low: float, high: float, x: Column) -> Column:
    """0 up to low, 1 from high, linear between."""
    return clamp((x - low) / (high - low), 0.0, 1.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 for equal hashes, 0 from 32 differing bits."""
    return clamp(1 - hamming(a, b) / 32, 0.0, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def bhattacharyya(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)


def scene_similarity(a: Column, b: Column) -> Column:
    """Of two structs luma, ab, ev, tint: histograms by Bhattacharyya coefficient, levels by a Gaussian of their distance."""
    apart = F.sqrt(F.aggregate(F.zip_with(a["tint"], b["tint"], lambda x, y: F.pow(x - y, F.lit(2))), F.lit(0.0), lambda s, v: s + v))
    level = F.exp(-F.pow((a["ev"] - b["ev"]) / 2, F.lit(2)) - F.pow(apart / 0.08, F.lit(2)))
    alike = lambda p, q: F.when((F.size(p) > 0) & (F.size(p) == F.size(q)), clamp(bhattacharyya(p, q), 0.0, 1.0)).otherwise(0.0)
    return 0.35 * alike(a["luma"], b["luma"]) + 0.35 * alike(a["ab"], b["ab"]) + 0.3 * level


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if either is empty."""
    empty = (F.size(a) <= 0) | (F.size(b) <= 0)
    return F.when(~empty, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def known_mean(*parts: tuple[float, Column]) -> Column:
    """Weighted mean over the parts that aren't null; 0 if all are."""
    total = sum((F.when(x.isNull(), F.lit(0.0)).otherwise(F.lit(w)) for w, x in parts), F.lit(0.0))
    value = sum((F.coalesce(x * w, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    return F.when(total > 0, clamp(value / total, 0.0, 1.0)).otherwise(F.lit(0.0))


def link_threshold(gap_ms: Column) -> Column:
    """The similarity needed to join a group whose last row is that much earlier: 0.3, 0.5, rising to 0.78."""
    far = 0.5 + (0.78 - 0.5) * ramp(30_000.0, 300_000.0, gap_ms.cast("double"))
    return F.when(gap_ms.isNull(), 0.78).when(gap_ms <= 2_000, 0.3).when(gap_ms <= 30_000, 0.5).otherwise(far)


def tier(similarity: Column, same_group: Column) -> Column:
    return F.when(similarity >= 0.9, "near_identical").when(similarity >= 0.7, "very_similar").when(same_group, "same_moment").otherwise("another_moment")


def ev100(iso: Column, shutter: Column, aperture: Column) -> Column:
    """Exposure value at ISO 100; null unless all are known and positive."""
    ok = (iso > 0) & (shutter > 0) & (aperture > 0)
    return F.when(ok, F.log2(aperture * aperture / shutter) - F.log2(iso / 100))


def mired(kelvin: Column) -> Column:
    return F.when(kelvin > 0, F.lit(1e6) / kelvin)


def iou(a: Column, b: Column) -> Column:
    """Of two boxes with x, y, width, height."""
    w = F.greatest(F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    both = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def prominence(box: Column) -> Column:
    """Share of the frame's height times closeness to the centre."""
    dx, dy = box["x"] + box["width"] / 2 - 0.5, box["y"] + box["height"] / 2 - 0.5
    return box["height"] * (1 - clamp(F.sqrt(dx * dx + dy * dy) / 0.75, 0.0, 1.0) * 0.5)


def linear(c: Column) -> Column:
    """Linear light of an sRGB value."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE L*a*b* (D65) of sRGB values in 0 to 1, as a struct l, a, b."""
    r, g, b = linear(r), linear(g), linear(b)
    f = lambda t: F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((24389 / 27 * t + 16) / 116)
    x, y, z = f((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047), f(0.2126729 * r + 0.7151522 * g + 0.072175 * b), f((0.0193339 * r + 0.119192 * g + 0.9503041 * b) / 1.08883)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def delta_e(p: Column, q: Column) -> Column:
    """CIEDE2000 colour difference of two structs l, a, b."""
    c1, c2 = F.hypot(p["a"], p["b"]), F.hypot(q["a"], q["b"])
    c7 = F.pow((c1 + c2) / 2, F.lit(7))
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 25.0**7)))
    a1, a2 = p["a"] * (1 + g), q["a"] * (1 + g)
    d1, d2 = F.hypot(a1, p["b"]), F.hypot(a2, q["b"])
    hue = lambda a, b: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(a1, p["b"]), hue(a2, q["b"])
    grey, turn = d1 * d2 == 0, h2 - h1
    dh = F.when(grey, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
    mean = F.when(grey, h1 + h2).when(F.abs(turn) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
    dl, dc, dbig = q["l"] - p["l"], d2 - d1, 2 * F.sqrt(d1 * d2) * F.sin(F.radians(dh / 2))
    ml, mc = (p["l"] + q["l"]) / 2, (d1 + d2) / 2
    t = 1 - 0.17 * F.cos(F.radians(mean - 30)) + 0.24 * F.cos(F.radians(2 * mean)) + 0.32 * F.cos(F.radians(3 * mean + 6)) - 0.2 * F.cos(F.radians(4 * mean - 63))
    m7 = F.pow(mc, F.lit(7))
    turned = -F.sin(F.radians(60 * F.exp(-F.pow((mean - 275) / 25, F.lit(2))))) * 2 * F.sqrt(m7 / (m7 + 25.0**7))
    sl, sc, sh = 1 + 0.015 * F.pow(ml - 50, F.lit(2)) / F.sqrt(20 + F.pow(ml - 50, F.lit(2))), 1 + 0.045 * mc, 1 + 0.015 * mc * t
    return F.sqrt(F.pow(dl / sl, F.lit(2)) + F.pow(dc / sc, F.lit(2)) + F.pow(dbig / sh, F.lit(2)) + turned * dc / sc * dbig / sh)
