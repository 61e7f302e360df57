"""SimHash near-deduplication over an inverted index of positional bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import bit_tally, byte_chunks, cut_lineage, map_arrow, narrow, roots, sorted_runs, spread_join
from shutterlake.llm.components import connected_components

SEED = 42
#: Shingles whose bits are tallied at once.
BLOCK = 1 << 16


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], n: int) -> list[bytes]:
    """Each run of n words joined by spaces, repeats included; the whole sequence if there are fewer; none if empty."""
    if len(tokens) <= n:
        return [b" ".join(tokens)] if tokens else []
    return [b" ".join(x) for x in zip(*(tokens[i:] for i in range(n)), strict=False)]


def majority(grams: list[bytes]) -> int:
    """64 bits, each set if it is set in over half of the grams' XXH64; 0 for no grams."""
    if not grams:
        return 0
    tally = np.zeros(64, np.int64)
    for i in range(0, len(grams), BLOCK):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[i : i + BLOCK]], "<u8")
        tally += bit_tally(h.view(np.uint8).reshape(-1, 8))
    return int(np.packbits(tally * 2 > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row: the SimHash of the text's word shingles as a signed long; 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, "text"):
            fp = np.array([majority(shingles(words(t), n)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = narrow(docs, id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def byte_keys(max_bits: int) -> list[int]:
    """Masks of 8 - max_bits of the 8 positional bytes: prints at most max_bits bits apart share one of them whole."""
    return [sum(0xFF << (8 * i) for i in kept) for kept in combinations(range(8), 8 - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(free: int, max_bits: int) -> np.ndarray:
    """All differences of one to max_bits bits among the bits of free."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return np.array([sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)], np.uint64)


def _links(keys: list[int], max_bits: int):
    """Links within each posting list of the index, as (print, smallest print that it reaches in the list).

    A list holds prints that share 8 - max_bits positional bytes, the guaranteed minimum, so count filtering leaves
    all of them; each pair is then verified on all bits. Short lists compare all pairs; longer ones look up every
    difference of max_bits bits outside the shared bytes among the sorted prints, so the work stays in proportion to
    the list. Gives out fewer links than a list has members.
    """

    def linked(fp: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        if len(fp) <= 128:
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= max_bits
            a, b = np.nonzero(np.triu(near, 1))
        else:
            at, other = [], []
            for d in _flips(~keys[key] & (1 << 64) - 1, max_bits):
                to = np.minimum(np.searchsorted(fp, fp ^ d), len(fp) - 1)
                hit = np.flatnonzero(fp[to] == fp ^ d)
                at.append(hit)
                other.append(to[hit])
            a, b = np.concatenate(at), np.concatenate(other)
        root = roots(a, b, len(fp))
        own = np.flatnonzero(root != np.arange(len(fp)))
        return fp[own], fp[root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in sorted_runs(batches, ["pos", "part"]):
            fp, size, a, b = cols["fp"].view(np.uint64), np.diff(starts), [], []
            two = starts[:-1][size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            a.append(fp[two])
            b.append(fp[two + 1])
            for s, e in zip(starts[:-1][size > 2], starts[1:][size > 2], strict=True):
                x, y = linked(np.sort(fp[s:e]), int(cols["pos"][s]))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def print_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that join all distinct prints (column fp, a signed long) at most max_bits bits apart, 1 to 4."""
    keys = byte_keys(max_bits)
    post = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("pos"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("part")) for i, k in enumerate(keys)]))
    index = prints.select("fp", post.alias("p")).select("p.pos", "p.part", "fp")
    lists = index.repartition("pos", "part").sortWithinPartitions("pos", "part")
    return map_arrow(lists, _links(keys, max_bits), "a long, b long")


def simhash_components(docs: DataFrame, n: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp, component_id, the smallest id reachable over prints at most max_bits bits apart.

    Copies share a print and are collapsed before the index is built, so a group of any size costs one print; rows meet
    their component by a join that spreads hot prints. A null or wordless text has print 0 and links like any other.
    Rows with a null id get the component's smallest id, or null if it has none. Repeated rows fall in one component.
    Empty tables give no rows; other columns are left out.
    """
    rows = cut_lineage(fingerprints(docs, n, id_col, text_col))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")))
    total = rows.count()
    label = connected_components(print_links(prints, max_bits))
    named = prints.join(label, prints["fp"] == label["node"], "left").select("fp", "lead", "n", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("lead").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    groups = spread_join(named, least, "label", "__n", total).select("fp", "n", "component_id")
    return spread_join(rows, groups, "fp", "n", total).select("id", "fp", "component_id")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
