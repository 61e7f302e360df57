"""String functions of the catalog, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; '' without a dot."""
    return F.when(F.instr(name, ".") == 0, F.lit("")).otherwise(F.lower(F.substring_index(name, ".", -1)))


def stem(name: Column) -> Column:
    """Text before the last dot, unless that dot comes first."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def known(text: Column) -> Column:
    """Null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def inside(path: Column, folder: Column) -> Column:
    """Whether the path lies under the folder, at a separator."""
    return path.startswith(F.concat(folder, F.lit("/")))


def safe_name(text: Column) -> Column:
    """Separators, colons and control characters as underscores."""
    return F.regexp_replace(text, r"[/\\:\x00-\x1f\x7f]", "_")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def fit_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within a number of UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    # a byte 10xxxxxx continues a character: step back over up to three of them
    cut = [F.when(F.conv(F.hex(F.substring(raw, limit + 1 - k, 1)), 16, 10).cast("int").between(128, 191), F.lit(False)).otherwise(True) for k in range(4)]
    take = F.when(cut[0], limit).when(cut[1], limit - 1).when(cut[2], limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), take), "UTF-8"))


_TOKEN = re.compile(r"\{(filename|seq(?::\d+)?|date(?::[^}]*)?|rating|camera|folder|id)\}")
_DATE = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "hh": "HH", "mm": "mm", "ss": "ss"}


def date_text(ms: Column, pattern: str) -> Column:
    """Milliseconds of naive wall clock in a pattern of YYYY YY MM DD hh mm ss; other text stays."""
    out = "".join(_DATE.get(p, "".join(f"'{p}'" if p.isalpha() else p)) for p in re.findall(r"YYYY|YY|MM|DD|hh|mm|ss|[A-Za-z]+|[^A-Za-z]+", pattern))
    return F.date_format(F.timestamp_millis(ms), out)


def expand(template: str, columns: dict[str, Column]) -> Column:
    """A file name from a template of {filename} {seq} {date} {rating} {camera} {folder} {id}; unknown values are empty.

    No leading dots and spaces, 240 bytes at most; a name of nothing gives way to the file's own, or the id's.
    """
    parts, at = [], 0
    for m in _TOKEN.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        name, _, arg = m[1].partition(":")
        value = columns[name]
        if name == "seq":
            value = F.lpad(value.cast("string"), int(arg or 4), "0")
        elif name == "date":
            value = date_text(value, arg or "YYYY-MM-DD")
        parts.append(F.coalesce(value.cast("string"), F.lit("")))
        at = m.end()
    parts.append(F.lit(template[at:]))
    out = fit_bytes(F.regexp_replace(safe_name(F.concat(*parts)), r"^[. ]+", ""), 240)
    plain = F.regexp_replace(safe_name(columns["filename"]), r"^[. ]+", "")
    other = F.when(F.length(plain) > 0, plain).otherwise(F.concat(F.lit("image-"), columns["id"].cast("string")))
    return F.when(F.length(F.trim(out)) > 0, out).otherwise(other)


def claim_names(df: DataFrame, folder: str, name: str, ext: str, order: list[Column]) -> DataFrame:
    """Column claimed: the name or, if an earlier row claims it, with the first of -2, -3 and so on that is free.

    Names are equal but for case, per folder; an earlier row is one that comes first in order. A name with a suffix may
    be another row's own name, so names that are alike but for such a suffix are settled together, one group at a time;
    a group's rows are held by one task.
    """
    number = F.row_number().over(Window.partitionBy(folder).orderBy(*order))
    root = F.regexp_replace(F.lower(name), r"(-[0-9]+)+$", "")
    rows = df.withColumn("__n", number).withColumn("__root", root)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def settle(pdf):
        pdf = pdf.sort_values("__n")
        taken, out = set(), []
        for stem, suffix in zip(pdf[name], pdf[ext], strict=True):
            made, k = stem, 1
            while f"{made}.{suffix}".lower() in taken:
                k += 1
                made = f"{stem}-{k}"
            taken.add(f"{made}.{suffix}".lower())
            out.append(f"{made}.{suffix}")
        return pdf.assign(claimed=out)

    return rows.groupBy(folder, "__root", F.lower(ext)).applyInPandas(settle, f"{kinds}, claimed string").drop("__n", "__root")
