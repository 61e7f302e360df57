"""Substring deduplication by hashing lines and content-defined runs of words: of units that repeat, the earliest stays.

A passage that begins or ends inside a line, or runs over several lines, has no line of its own. So texts are also cut
into runs of words at places that only the words around them choose; equal passages are cut alike inside, wherever they
stand. Two passes keep the shuffle small: the first fills a filter with the digests of all units, the second sends on
only units whose digest may be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import byte_chunks, cut_lineage, from_words, map_arrow, mix, narrow, spread_join, text_buffer, word_keys
from shutterlake.llm.exact_dedup import maybe_udf, position_filter, positions

#: Words of a line, and of a run, from which on it is a unit.
MIN_WORDS, MIN_RUN = 8, 6
#: A run begins at a word whose hash with the word before is less than those of so many words on either side.
RADIUS = 4
#: Text that is cut into units at once, and bytes of text for which a unit is reckoned in the filter's size.
CHUNK_BYTES, UNIT_BYTES = 1_000_000, 48
#: Upper bound of each of the two broadcast filters.
MAX_FILTER_BYTES = 32 << 20

_SPAN = "array<struct<start:bigint,end:bigint>>"


def units(texts: pa.Array, min_words: int = MIN_WORDS, min_run: int = MIN_RUN, radius: int = RADIUS) -> tuple[np.ndarray, ...]:
    """(text, start, end, digest) of the units of all texts: lines, then runs; offsets count characters.

    Words are runs of bytes other than ASCII white space; A-Z and the capitals of Latin-1 count as lower case. A unit is
    equal to another if its words are; white space doesn't count. The digest is two unsigned longs.
    """
    raw, at = text_buffer(texts)
    start, stop, key = word_keys(raw)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    doc = np.searchsorted(at, start, "right") - 1
    first = np.append(True, doc[1:] != doc[:-1])
    before = np.append(np.uint64(0), key[:-1])
    before[first] = 0
    h = mix(before * np.uint64(0xD6E8FEB86659FD93) + key)
    low = np.ones(len(h), bool)
    for s in range(1, min(radius, len(h) - 1) + 1):
        same = doc[s:] == doc[:-s]
        low[s:] &= ~same | (h[s:] < h[:-s])
        low[:-s] &= ~same | (h[:-s] < h[s:])
    lines = np.cumsum(raw == 10)[start]
    new_line = first | np.append(True, lines[1:] != lines[:-1])
    parts = []
    for new, least in ((new_line, min_words), (first | low, min_run)):
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(start))
        parts.append(np.stack([a, b], 1)[b - a >= least])
    a, b = np.concatenate(parts).T
    char = np.cumsum((raw & 0xC0) != 0x80)
    base = np.append(0, char)[at[:-1]][doc[a]]
    digest = np.stack([from_words(key, a, b), from_words(mix(key ^ np.uint64(0x5851F42D4C957F2D)), a, b)], 1)
    return doc[a], char[start[a]] - 1 - base, char[stop[b - 1] - 1] - base, digest


def _digests(min_words: int, min_run: int):
    """The first half of each unit's digest, for the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, "text", CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(units(b.column(0), min_words, min_run)[3][:, 0].view(np.int64))], ["h"])

    return run


def _explode(min_words: int, min_run: int, sent, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, "text", CHUNK_BYTES):
            doc, start, end, digest = units(b.column(2), min_words, min_run)
            p = positions(np.ascontiguousarray(digest[:, 0]), bits)
            ok = np.flatnonzero(((sent.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(1)) if len(p) else np.zeros(0, np.int64)
            at = pa.array(doc[ok])
            name = pa.Array.from_buffers(pa.binary(16), len(ok), [None, pa.py_buffer(np.ascontiguousarray(digest[ok]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start[ok]), pa.array(end[ok]), name], ["id", "row", "start", "end", "digest"])

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(id, row, spans) for documents with a unit that is repeated from an earlier place; spans has (start, end).

    Places rank by id (null last), then the text's hash, then offset. row is the hash of the text, so that different
    texts under one id stay apart; rows that repeat id and text are one document. Only digests and offsets of units
    that the filter lets through are shuffled; a full filter lets more through and changes no result. Groups are
    reduced to count and earliest place before a join that spreads common units.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = narrow(docs, id=id_col, row=F.xxhash64(text), text=text)
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    repeated, bits = position_filter(rows.select("text"), size // UNIT_BYTES, max_filter_bytes, 2, _digests(min_words, min_run))
    sent = docs.sparkSession.sparkContext.broadcast(repeated)
    found = cut_lineage(map_arrow(rows, _explode(min_words, min_run, sent, bits), f"id {kind}, row long, start long, end long, digest binary"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "start")
    groups = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    met = spread_join(found, groups, "digest", "__n", max(1, found.count()))
    cut = met.filter(F.col("first").isNotNull() & (place != F.col("first")))
    return cut.groupBy("id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and what was removed: a line that goes whole takes its line feed along, else one side's spaces."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and not text[merged[-1][1] : s].strip(" \t\r\n\v\f"):
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    out, gone, at = [], [], 0
    for s, e in merged:
        left, right = s, e
        while left > at and text[left - 1] in " \t\r\v\f":
            left -= 1
        while right < len(text) and text[right] in " \t\r\v\f":
            right += 1
        begins, ends = left == 0 or text[left - 1] == "\n", right == len(text) or text[right] == "\n"
        if begins and ends:
            s, e = left, min(len(text), right + 1)
            if right == len(text) and left > at:
                s -= 1
        elif ends:
            s, e = left, right
        else:
            e = right
        s = max(s, at)
        out.append(text[at:s])
        gone.append((s, e))
        at = e
    return "".join([*out, text[at:]]), gone


def _cut(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_chunks(iter([whole]), whole.schema.names[text_at], CHUNK_BYTES):
                done = [cut_spans(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(b.column(text_at).to_pylist(), b.column(spans_at).to_pylist(), strict=True)]
                cols = list(b.columns)
                cols[text_at] = pa.array([d[0] for d in done], b.schema.types[text_at])
                cols[spans_at] = pa.array([[{"start": s, "end": e} for s, e in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """docs, with the repeated units cut from the text, and removed_spans: (start, end) in the original's characters.

    Units are lines of min_words words or more and runs of min_run words or more (see units). Of units with equal words,
    within a document or across documents, the earliest place stays. A line that is repeated whole goes with its line
    feed, a run with the spaces on one side. A passage's words before its first and after its last cut inside stay;
    with RADIUS that is about eight words at either end. A null text stays null, a text without a repeated unit
    stays as it is, and one that is repeated whole becomes empty. Rows that repeat an id and text are cut alike. Empty
    tables give no rows. All columns and rows of docs stay; a column of docs that is named removed_spans is replaced.
    Only documents whose key may have spans meet them in a shuffle; the others go straight through.
    """
    spans = cut_lineage(repeated_spans(docs, min_words, min_run, id_col, text_col, max_filter_bytes).select(F.xxhash64("id", "row").alias("__h"), F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("spans").alias("__spans")))
    touched = maybe_udf(docs.sparkSession, *position_filter(spans.select("__h"), spans.count(), max_filter_bytes, 1))
    names = [c for c in docs.columns if c != "removed_spans"]
    own = F.col(f"`{text_col}`")
    keyed = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("__text_hash", F.xxhash64(F.coalesce(own.cast("string"), F.lit(""))))
    keyed = keyed.withColumn("__touched", touched(F.xxhash64(F.col(f"`{id_col}`"), F.col("__text_hash"))))
    none = F.array().cast(_SPAN).alias("removed_spans")
    plain = [F.col(f"`{c}`") for c in names]
    met = keyed.filter("__touched").join(spans, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__row")), "left")
    met = met.select(*plain, F.col("__spans").cast(_SPAN).alias("removed_spans"))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(met.schema.fields))
    cut = map_arrow(met.filter("removed_spans IS NOT NULL").toDF(*[f"c{i}" for i in range(len(names) + 1)]), _cut(names.index(text_col), len(names)), kinds).toDF(*met.columns)
    rest = met.filter("removed_spans IS NULL").select(*plain, none)
    return keyed.filter("NOT __touched").select(*plain, none).unionByName(rest).unionByName(cut)
