"""Sharding by a keyed permutation of global row numbers, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import cut_lineage, narrow

ROUNDS = 4
#: The round function works modulo this prime.
PRIME = 2147483647
#: A longer walk back into the domain can't happen below 4,097 rows, and has a chance below 2^-300 above.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below PRIME for each round, from the seed."""
    x, out = (seed * 48271 + 11) % PRIME, []
    for _ in range(ROUNDS):
        a = x = (x * 48271 + 12345) % PRIME
        b = x = (x * 48271 + 12345) % PRIME
        out.append((a, 1 + b % (PRIME - 1)))
    return out


def radices(n: int) -> tuple[int, int]:
    """The sides a >= b of the grid on which n numbers are permuted: a * b >= n, fewer than a too many."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def _mix(x: Column, key: tuple[int, int]) -> Column:
    """Two squarings and a multiplication modulo PRIME; all products stay below 2^62."""
    y = F.pmod(x + F.lit(key[0]).cast("long"), F.lit(PRIME))
    y = F.pmod(y * y + F.lit(key[1]).cast("long"), F.lit(PRIME))
    y = F.pmod(y * y + y * F.lit(key[1]).cast("long") % F.lit(PRIME), F.lit(PRIME))
    return y


def _round(key: tuple[int, int], side: Column, left: bool) -> Callable[[Column], Column]:
    """One round, as a function of the pair: transform over one element names the pair once, so that rounds don't multiply the expression."""

    def step(p: Column) -> Column:
        if left:
            return F.struct(F.pmod(p["l"] + _mix(p["r"], key), side).alias("l"), p["r"].alias("r"))
        return F.struct(p["l"].alias("l"), F.pmod(p["r"] + _mix(p["l"], key), side).alias("r"))

    return step


def _feistel(x: Column, n: int, seed: int) -> Column:
    """One pass over the grid: alternately add a keyed function of one coordinate to the other."""
    a, b = (F.lit(v).cast("long") for v in radices(n))
    pair = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
    for i, key in enumerate(round_keys(seed)):
        pair = F.transform(F.array(pair), _round(key, a if i % 2 == 0 else b, i % 2 == 0))[0]
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """The place of number x, 0 <= x < n, in a keyed permutation of 0 to n - 1.

    A Feistel network over a grid of about sqrt(n) by sqrt(n) permutes slightly more than n numbers; cycle walking
    applies it again until the number is below n. Computable for any row number without data.
    """
    n_ = F.lit(n).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _feistel(x, n, seed), lambda acc, _: F.when(acc < n_, acc).otherwise(_feistel(acc, n, seed)))
    return F.when(walked < n_, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with a gapless row_no, from 0, in the given order; and the number of rows.

    Rows are dealt by range, sorted, and written to the checkpoint folder, so that all that follows sees the same
    ranges. Partition sizes, one small row per partition, give each partition's first number.
    """
    ranged = cut_lineage(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).cast("int")
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = sizes.withColumn("__first", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("__rows")).first()[0] or 0
    out = ranged.withColumn("__part", part).join(F.broadcast(before.select("__part", "__first")), "__part")  # a row for each partition
    return out.withColumn("row_no", F.col("__first") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__first", "__id"), total


def shard(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, row_no, position, shard, slot.

    Rows are numbered in the order of id, then text_crc32 and size, and permuted; position p goes to shard p mod shards
    and slot p div shards. Shards differ by one row at most, slots are gapless, and the same rows give the same shards.
    Null ids come first; a null text has size 1 and checksum 0; rows equal in all three get numbers side by side, and it
    doesn't matter which gets which. An empty table gives no rows. Other columns are left out. Two sorts of narrow
    rows and no Python.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = narrow(docs, **{"id": id_col, "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    numbered, n = number_rows(rows, ["id", "text_crc32", "size"])
    placed = numbered.withColumn("position", permute(F.col("row_no"), n, seed))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", ((F.col("position") - F.col("position") % shards) / shards).cast("long"))
