"""Exact deduplication by a two-pass Bloom filter: only rows whose hash may be repeated are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import cut_lineage, map_arrow, narrow, spread_join

#: Bits of one slice of the filter; a slice is what one reducer row holds.
SLICE = 1 << 20
#: Rows that one task gathers before it gives out their positions.
CHUNK = 1 << 20


def filter_bits(rows: int, max_bytes: int) -> int:
    """A power of two, 16 bits a row, as far as max_bytes goes."""
    return max(1 << 12, min(max_bytes * 8, 1 << max(0, (16 * max(rows, 1) - 1).bit_length())))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The two positions of each 64-bit hash, one row for each hash."""
    u = h.view(np.uint64)
    return np.stack([u & np.uint64(bits - 1), (u >> np.uint64(32)) & np.uint64(bits - 1)], 1).astype(np.int64)


def _seen(bits: int):
    """First pass, in each task: which positions of a slice it met once, and which more often."""

    def run(batches):
        def out(parts):
            p, n = np.unique(np.sort(np.concatenate(parts), 1).ravel() if len(parts) else np.zeros(0, np.int64), return_counts=True)
            s = p // SLICE
            for k in np.unique(s):
                own = s == k
                at = (p[own] - k * SLICE).astype(np.uint32)
                yield int(k), at.tobytes(), at[n[own] > 1].tobytes()

        def give(parts):
            rows = list(out(parts))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "once", "twice"])

        parts, held = [], 0
        for b in batches:
            parts.append(positions(b.column(0).to_numpy(zero_copy_only=False), bits))
            held += b.num_rows
            if held >= CHUNK:
                yield give(parts)
                parts, held = [], 0
        if parts:
            yield give(parts)

    return run


def _joined(bits: int, least: int):
    """Then, for each slice: the positions met once or twice at least over all tasks, as a bitmap. Holds two bits a position."""

    def run(batches):
        once, twice = {}, {}
        for b in batches:
            for k, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k not in once:
                    once[k], twice[k] = np.zeros(min(bits, SLICE), bool), np.zeros(min(bits, SLICE), bool)
                at = np.frombuffer(x, np.uint32)
                twice[k][at[once[k][at]]] = True
                twice[k][np.frombuffer(y, np.uint32)] = True
                once[k][at] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([np.packbits(v).tobytes() for v in (twice if least > 1 else once).values()], pa.binary())], ["slice", "map"])

    return run


def position_filter(hashes: DataFrame, rows: int, max_bytes: int, least: int, prepare=None) -> tuple[np.ndarray, int]:
    """The bitmap of positions that least rows (1 or 2) of hashes (one long column) set at least; at most max_bytes.

    prepare makes the long column from batches of other columns, in the same pass.
    """
    bits = filter_bits(rows, max_bytes)
    slices = max(1, bits // SLICE)
    seen = _seen(bits)
    met = map_arrow(hashes, seen if prepare is None else lambda batches: seen(prepare(batches)), "slice int, once binary, twice binary").repartition(slices, "slice")
    whole = np.zeros(bits // 8, np.uint8)
    for r in map_arrow(met, _joined(bits, least), "slice int, map binary").collect():  # max_bytes in all
        part = np.frombuffer(bytes(r["map"]), np.uint8)
        whole[r["slice"] * SLICE // 8 :][: len(part)] = part
    return whole, bits


def maybe_udf(spark, bitmap: np.ndarray, bits: int):
    """Whether the filter lets a hash through."""
    sent = spark.sparkContext.broadcast(bitmap)

    def maybe(h: pd.Series) -> pd.Series:
        p = positions(h.to_numpy(np.int64), bits)
        got = (sent.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
        return pd.Series(got.all(1))

    return F.pandas_udf(maybe, "boolean")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = narrow(docs, id=id_col, sha=F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256))
    return rows.withColumn("h", F.xxhash64("sha"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: id, sha, keep_id, group_size, kept. Of equal texts, the row with the largest id stays.

    The first pass gathers which filter positions two or more rows set; the second sends only rows whose positions are
    all of that kind through a shuffle, narrowed to id and hash, and passes the others straight through. The broadcast
    filter never exceeds max_filter_bytes; beyond 16 million rows at the default it admits more rows to the shuffle and
    the result stays the same. A null text counts as empty. Null ids are smaller than any other. Rows that repeat an id
    and its text are one document to this table: all of them are kept or none. Empty tables give no rows; other columns
    are left out. A hash may have any share of the rows.
    """
    rows = cut_lineage(_hashed(docs, id_col, text_col))
    total = rows.count()
    maybe = maybe_udf(docs.sparkSession, *position_filter(rows.select("h"), total, max_filter_bytes, 2))
    marked = rows.withColumn("maybe", maybe("h"))
    alone = marked.filter("NOT maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rest = marked.filter("maybe").select("id", "sha")
    groups = rest.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = spread_join(rest, groups, "sha", "group_size", total)
    return alone.unionByName(joined).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps; of rows that repeat an id and text, one."""
    names = docs.columns
    key = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)
    rows = cut_lineage(_hashed(docs, id_col, text_col))
    total = rows.count()
    maybe = maybe_udf(docs.sparkSession, *position_filter(rows.select("h"), total, max_filter_bytes, 2))
    wide = docs.withColumn("__sha", key).withColumn("__maybe", maybe(F.xxhash64("__sha")))
    groups = rows.withColumn("__maybe", maybe("h")).filter("__maybe").groupBy(F.col("sha").alias("__sha")).agg(F.max("id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    rest = spread_join(wide.filter("__maybe"), groups, "__sha", "__size", total)
    kept = rest.filter(F.col(f"`{id_col}`").eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"])
    return wide.filter("NOT __maybe").select(*[F.col(f"`{c}`") for c in names]).unionByName(kept.select(*[F.col(f"`{c}`") for c in names]))
