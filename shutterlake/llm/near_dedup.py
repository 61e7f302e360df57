"""Near-copies on shingles of five words: SimHash and MinHash bands find candidates, the exact Jaccard similarity decides.

The prints of op10's operator, linked over its index of positional bytes, come first: each text meets the first one of
its print, and each print those it is linked with.

A minimum over the shingles agrees in two texts as often as their similarity, whatever the edit is: words replaced, a
passage put in, appended or cut off. A print's bits have no such minimum at a similarity of 0.8, so bands add the pairs
whose prints are further apart. Each text has BANDS keys
of BAND_ROWS minima; two texts at 0.8 share none with a chance of (1 - 0.8 ** 4) ** 20, which is 0.003 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import simhash
from shutterlake.llm.common import byte_chunks, cut_lineage, from_words, map_arrow, mix, narrow, roots, sorted_runs, spread_join, text_buffer, word_keys
from shutterlake.llm.components import connected_components
from shutterlake.llm.exact_dedup import position_filter, positions

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 20, 4
#: Minima of a text: all make its keys, four bits of each of the first 64 its sketch.
MINIMA, SKETCHED = BANDS * BAND_ROWS, 64
#: Shingles whose minima are taken at once, and text whose shingles are.
AT_ONCE, CHUNK_BYTES = 4096, 1_000_000
#: Members of a posting list up to which all its pairs are candidates; in a longer one the first member meets all others.
SMALL = 8
#: Sets, and bytes of sets, of a block: the sets of two blocks are compared at once. Columns of the product that counts what they share.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 16 << 20, 4096
#: Upper bound of the broadcast filter that tells whose sets are wanted.
MAX_FILTER_BYTES = 32 << 20

_SEEDS = np.random.default_rng(5).integers(0, 1 << 32, (2, MINIMA), dtype=np.uint32)
_XOR, _TIMES = _SEEDS[0], _SEEDS[1] | np.uint32(1)
_SKETCH = [f"s{i}" for i in range(SKETCHED // 16)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted hashes of the distinct runs of WORDS words; of all words if there are fewer; none without words."""
    raw, at = text_buffer(texts)
    start, _, key = word_keys(raw)
    cut = np.searchsorted(start, at)
    first, n = cut[:-1], np.diff(cut)
    a = np.arange(len(key))
    b = np.minimum(a + WORDS, np.repeat(cut[1:], n))
    whole = b - a == np.minimum(WORDS, np.repeat(n, n))  # the last few words of a text begin no run
    found = from_words(key, a[whole], b[whole])
    ends = np.append(0, np.cumsum(whole))[cut]
    return [np.unique(found[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets given as sorted distinct numbers."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def minima(found: np.ndarray) -> np.ndarray:
    """For each of MINIMA orders of all hashes, the least of a set."""
    low = found.astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), AT_ONCE):
        x = low[i : i + AT_ONCE, None] ^ _XOR
        x *= _TIMES
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(0), out=least)
    return least


def keys_and_sketch(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From rows of minima: each row's band keys, and its sketch as unsigned longs."""
    m = least.astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(m), BANDS))
    for i in range(BAND_ROWS):
        key = mix((key << np.uint64(1)) + m[:, i::BAND_ROWS] + (key << np.uint64(33)))
    bits = (mix(m[:, :SKETCHED] + (np.arange(SKETCHED, dtype=np.uint64) << np.uint64(32))) & np.uint64(15)).astype(np.uint8)
    return key, np.ascontiguousarray(bits[:, ::2] | bits[:, 1::2] << 4).view(np.uint64)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sketched minima differ in their four bits."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def most_unlike(similarity: float, deviations: float = 5.0) -> int:
    """Minima whose sketches differ in two sets of the given similarity, and some standard deviations more."""
    p = (1 - similarity) * 15 / 16
    return math.floor(SKETCHED * p + deviations * math.sqrt(SKETCHED * p * (1 - p)))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in byte_chunks(batches, "text", CHUNK_BYTES):
        sets = shingle_sets(b.column(1))
        have = [i for i, x in enumerate(sets) if len(x)]
        key, sketch = keys_and_sketch(np.array([minima(sets[i]) for i in have], np.uint32).reshape(-1, MINIMA))
        cut = pa.array(np.arange(len(have) + 1) * BANDS, pa.int32())
        cols = [b.column(0).take(pa.array(have, pa.int32())), pa.array([len(sets[i]) for i in have], pa.int64())]
        cols += [pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(len(_SKETCH))]
        yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(cut, pa.array(key.reshape(-1).view(np.int64)))], ["node", "size", *_SKETCH, "keys"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and node: each key's distinct nodes, if there are two or more, and their number n."""
    for cols, _ in sorted_runs(batches, ["key"]):
        key, node = cols["key"], cols["node"]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        cols = {k: v[new] for k, v in cols.items()}
        starts = np.flatnonzero(np.append(True, cols["key"][1:] != cols["key"][:-1]))
        n = np.diff(np.append(starts, len(cols["key"])))
        n = np.repeat(n, n)
        out = {k: v[n > 1] for k, v in cols.items()} | {"n": n[n > 1].astype(np.int64)}
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], list(out))


def _candidates(similarity: float):
    """Pairs of a list's members: all of a short list, those with the first member of a longer one.

    Only pairs go whose sizes allow the similarity and whose sketches differ in at most most_unlike minima.
    """
    most = most_unlike(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in sorted_runs(batches, ["key"]):
            node, size, x = cols["node"], cols["size"], np.stack([cols[s] for s in _SKETCH], 1).view(np.uint64)
            a, b = [node[:0]], [node[:0]]

            def meet(i, j):
                few, many = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                ok = (few / many >= similarity) & (unlike(x[i], x[j]) <= most)
                i, j = np.broadcast_arrays(i, j)
                a.append(node[i[ok]])
                b.append(node[j[ok]])

            n = np.diff(starts)
            for k in range(2, SMALL + 1):
                s = starts[:-1][n == k]
                for i in range(k):
                    for j in range(i + 1, k):
                        meet(s + i, s + j)
            for s, e in zip(starts[:-1][n > SMALL], starts[1:][n > SMALL], strict=True):
                meet(np.array([s]), np.arange(s + 1, e))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b)], ["a", "b"])

    return run


def print_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of rows (node, text) by SimHash: equal prints, and all links of prints at most two bits apart.

    A text meets the least node of its print; linked prints meet by their least nodes. Texts without words, of print 0, don't.
    """
    prints = cut_lineage(simhash.fingerprints(rows, id_col="node").filter("fp <> 0"))
    leads = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")))
    same = spread_join(prints, leads, "fp", "n", max(1, prints.count())).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    met = links = cut_lineage(simhash.print_links(leads))
    total = max(1, links.count())
    for key in ("a", "b"):
        own = links.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{key}")).join(leads.select(F.col("fp").alias(key), F.col("lead").alias(f"lead_{key}")), key)
        met = spread_join(met, own, key, f"n_{key}", total)
    both = same.union(met.select("lead_a", "lead_b"))
    return both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(wanted, bits: int):
    """The sets of the texts whose node the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = positions(b.column(0).to_numpy(), bits)
            ok = ((wanted.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(1)
            for c in byte_chunks(iter([b.filter(pa.array(ok))]), "text", CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([x.tobytes() for x in shingle_sets(c.column(1))], pa.binary())], ["node", "set"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(i)] for i in (2, 3))
            ok = pa.array([jaccard(p, q) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) have the similarity or more; a node with many pairs is spread."""
    total = max(1, pairs.count())
    met = pairs
    for key in ("a", "b"):
        own = pairs.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{key}")).join(sets.select(F.col("node").alias(key), F.col("set").alias(f"set_{key}")), key)
        met = spread_join(met, own, key, f"n_{key}", total).drop(f"n_{key}")
    return cut_lineage(map_arrow(met.select("a", "b", "set_a", "set_b"), _alike(similarity), "a long, b long"))


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set on the left shares with each on the right, as sums of products of 0 and 1."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float64)
    for c in range(0, len(both), COLUMNS):
        some = both[c : c + COLUMNS]
        held = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(some)), np.float32)
            for k, x in enumerate(sets):
                x = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
                at = np.searchsorted(some, x)
                m[k, at[some[at] == x]] = 1
            held.append(m)
        out += held[0] @ held[1].T
    return out


def _block_links(similarity: float):
    """In a pair of blocks: links that join all sets with the similarity, one for each set at most."""

    def run(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        node, block = t["node"].to_numpy(), t["block"].to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["set"]]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = shared([sets[k] for k in left], [sets[k] for k in right])
        size = np.array([len(x) for x in sets], np.float64)
        p, q = np.nonzero(both / (size[left][:, None] + size[right][None, :] - both) >= similarity)
        root = roots(left[p], right[q], len(node))
        own = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": pa.array(node[own]), "b": pa.array(node[root[own]])})

    return run


def open_links(long: DataFrame, label: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links within the long lists (key, node) that the components (node, label) found so far don't join whole.

    The open lists' members make clusters, of lists that share members. A cluster is cut into blocks, and each pair of
    blocks is one task that counts what all its sets share and gives out at most one link for each, never pairs.
    """
    now = long.select("key", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = now.groupBy("key").agg(F.min("node").alias("first"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "first")
    edges = cut_lineage(now.join(apart, "key").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    if edges.isEmpty():
        return None
    members = connected_components(edges).withColumnRenamed("label", "cluster").join(sets, "node")
    members = cut_lineage(members)
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("set").cast("long")) / BLOCK_BYTES)).cast("int")
    per = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts"))
    dealt = spread_join(members, per, "cluster", "n", members.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("cluster", "node", "set", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return cut_lineage(pairs.groupBy("cluster", "i", "j").applyInArrow(_block_links(similarity), "a long, b long"))


def near_links(rows: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """For rows (node, text): verified links (a, b), and the components (node, label) that they make.

    Links join what all pairs of the posting lists at the similarity would join, and what SimHash links at it. A short list's pairs are verified one by
    one. In a longer list the first member meets all others; lists that this doesn't join whole are compared in blocks.
    """
    index = map_arrow(rows, _indexed, f"node long, size long, {', '.join(f'{s} long' for s in _SKETCH)}, keys array<long>")
    index = index.select(F.explode("keys").alias("key"), "node", "size", *_SKETCH).repartition("key").sortWithinPartitions("key", "node")
    lists = cut_lineage(map_arrow(index, _lists, f"key long, node long, size long, {', '.join(f'{s} long' for s in _SKETCH)}, n long"))
    pairs = cut_lineage(print_pairs(rows).union(map_arrow(lists, _candidates(similarity), "a long, b long")).distinct())
    long = lists.filter(F.col("n") > SMALL)
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(long.select("node")).distinct()
    wanted, bits = position_filter(need, need.count(), MAX_FILTER_BYTES, 1)
    sets = cut_lineage(map_arrow(rows, _sets(rows.sparkSession.sparkContext.broadcast(wanted), bits), "node long, set binary").dropDuplicates(["node"]))
    links = verified(pairs, sets, similarity)
    label = connected_components(links)
    more = open_links(long, label, sets, similarity)
    if more is not None and not more.isEmpty():
        links = links.union(more)
        label = connected_components(links)
    return links, label


def near_components(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, lead): for each document its node and the component's first id; node is the hash of id and text.

    Candidates have linked prints or share a band of minima; a candidate links if the Jaccard similarity of its distinct shingles is at least
    the one given. Texts without words link with nothing. Null ids rank last. Rows that repeat id and text are one
    document. Lists, pairs, sets of candidates and links are written to the checkpoint folder; no text is shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = narrow(docs, id=id_col, node=F.xxhash64(F.col(f"`{id_col}`"), text), text=text)
    _, label = near_links(rows.select("node", "text"), similarity)
    ids = rows.select("id", "node").distinct()
    named = ids.join(label, "node", "inner")
    least = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "node")).alias("lead"))
    return named.join(least, "label").select("id", "node", F.col("lead.node").alias("lead"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, without the documents of a group of near-copies other than that with the smallest id.

    Documents outside any group always stay, also those with a null or empty text; empty tables stay empty.
    """
    gone = near_components(docs, similarity, id_col, text_col).filter("node <> lead").select(F.col("node").alias("__gone")).distinct()
    names = docs.columns
    keyed = docs.withColumn("__node", F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    return keyed.join(gone, F.col("__node") == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in names])
