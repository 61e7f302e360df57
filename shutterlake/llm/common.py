"""What several operators share: narrow views of documents, joins that spread hot keys, runs of sorted batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut_lineage, ensure_workers  # noqa: F401

_ODD = np.uint64(0x9E3779B97F4A7C15)
_HASH_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True

#: A key is hot if it has more than this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3


def narrow(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under the given names: whatever else df has can't clash with an operator's own columns."""
    ensure_workers(df.sparkSession)
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def spread_join(left: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with their group's values, where one key may have any share of the rows.

    groups has one row per key and the key's number of rows in size; the sizes add up to total at most. Keys with over
    HOT_SHARE of the rows, at most 1 / HOT_SHARE of them whatever the input's size, are joined by broadcast. Their rows
    get a salt of their own, so that the shuffle join of the other keys deals them out evenly. Keys must not be null.
    """
    limit = max(64, int(total * HOT_SHARE))
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > limit).select(F.col(key).alias("__k"), F.struct(*values).alias("__hot"))
    zero = (F.col(size) < 0).cast("long")  # a literal would be folded away, and rows dealt by the key alone
    cold = groups.filter(F.col(size) <= limit).select(F.col(key).alias("__k"), zero.alias("__s"), F.struct(*values).alias("__cold"))
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    marked = left.join(F.broadcast(hot), left[key] == F.col("__k"), "left").drop("__k").withColumn("__salt", salt.cast("long"))
    out = marked.join(cold, (marked[key] == cold["__k"]) & (marked["__salt"] == cold["__s"]), "left")
    return out.select(*[left[f"`{c}`"] for c in left.columns], *[F.coalesce(F.col(f"__hot.{v}"), F.col(f"__cold.{v}")).alias(v) for v in values])


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """From batches sorted by keys: the columns and where runs of equal keys begin, with the end; runs are never cut."""
    held: list[dict[str, np.ndarray]] = []  # parts of the run that isn't over
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if held and all(held[0][k][0] == now[k][-1] for k in keys):
            held.append(now)
            continue
        now = {n: np.concatenate([*(h[n] for h in held), now[n]]) for n in now}
        n = len(now[keys[0]])
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= now[k][1:] != now[k][:-1]
        starts = np.flatnonzero(new)
        held = [{k: v[starts[-1] :] for k, v in now.items()}]
        if len(starts) > 1:
            yield {k: v[: starts[-1]] for k, v in now.items()}, starts
    if held:
        rest = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        yield rest, np.array([0, len(rest[keys[0]])])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the undirected links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def byte_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of text, one row at least: bounds what vectorised code holds."""
    for batch in batches:
        size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())], np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def let_go() -> None:
    """Give back memory that isn't used any more: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema); each task gives back its memory."""
    ensure_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            let_go()

    return df.mapInArrow(run, schema)


def bit_tally(data: np.ndarray) -> np.ndarray:
    """How many rows of bytes have each bit, lowest bit of a byte first. Adds eight bits' counts in one 64-bit number."""
    if not len(data):
        return np.zeros(8 * data.shape[1], np.int64)
    lanes = np.unpackbits(data, axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(data), 255), axis=0)  # a count of up to 255 fits in its byte
    return sums.view(np.uint8).reshape(len(sums), -1).sum(0, dtype=np.int64)


class Memory:
    """Results of a function of byte strings, remembered in two generations: what is used again stays, the rest is let go."""

    def __init__(self, size: int, longest: int) -> None:
        self.size, self.longest = size, longest
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def all(self, keys: list[bytes], f: Callable[[list[bytes]], list]) -> list:
        """f of each of the distinct keys; f gets only those that aren't remembered."""
        young, old = self.young.get, self.old.get
        out = [young(k) or old(k) for k in keys]
        new = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(new, f([keys[i] for i in new]), strict=True):
            out[i] = x
        if len(self.young) + len(keys) > self.size:
            self.old, self.young = self.young, {}
        self.young.update((k, x) for k, x in zip(keys, out, strict=True) if len(k) <= self.longest)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit number's bits, spread over all places; one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the hash's base modulo 2**64, and of its inverse; what is kept is bounded."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    out = []
    for base in (_HASH_BASE, pow(_HASH_BASE, -1, 1 << 64)):
        steps = np.full(n, np.uint64(base))
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if n <= 1 << 22:
        _POWERS[:] = out
    return out[0], out[1]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in lower case (A-Z and the capitals of Latin-1), a line feed after each; where each begins, with the end."""
    kind = pa.large_string()
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(kind), pa.scalar("", kind)), pa.scalar("", kind), pa.scalar("\n", kind))
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    after = np.append(False, raw[:-1] == 0xC3)
    raw[after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 32
    return raw, at - at[0]


def word_keys(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, 64-bit key) of the words, runs other than ASCII white space, of bytes that end in white space.

    A key is a polynomial of the word's bytes, got from prefix sums over the whole buffer.
    """
    up, down = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
    edge = np.diff(np.append(True, _WHITE[raw]).view(np.int8)) if len(raw) else np.zeros(0, np.int8)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, stop, mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64) * _ODD)


def from_words(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of the words a to b - 1, for each pair of places."""
    up, down = powers(len(key) + 1)
    prefix = np.append(np.uint64(0), np.cumsum(key * up[: len(key)], dtype=np.uint64))
    return mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64) * _ODD)
