"""Embedding near-deduplication: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import cut_lineage, map_arrow, narrow, roots, spread_join
from shutterlake.llm.components import connected_components

#: Vectors of a cell on average, most vectors of a block, and most vectors that the cells are fitted on.
CELL, BLOCK, SAMPLE = 4096, 4096, 50_000
ROUNDS = 8
#: What rounding may add to a distance from a border.
SLACK = 1e-6
#: Rows whose products are taken at once.
AT_ONCE = 1024


def fit_cells(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k unit centroids of the unit rows of x, by spherical k-means; holds AT_ONCE rows of products."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        sums = np.zeros_like(c)
        for s in range(0, len(x), AT_ONCE):
            np.add.at(sums, (x[s : s + AT_ONCE] @ c.T).argmax(1), x[s : s + AT_ONCE])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def reach(threshold: float) -> float:
    """How far from the border between two cells the nearer of two linked vectors lies at most.

    Linked vectors are at most a chord of sqrt(2 - 2 threshold) apart. If they lie on two sides of a border, their
    distances from it add up to no more than that, so one of the two is within half of it.
    """
    return math.sqrt(max(0.0, 2 - 2 * threshold)) / 2


def cells_of(x: np.ndarray, c: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, cell, the vector's own cell) for the cell of the nearest centroid, and all whose border is within far."""
    dots = x @ c.T
    own = dots.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))[own]
    beyond = (dots[np.arange(len(x)), own][:, None] - dots) / apart
    beyond[np.arange(len(x)), own] = -1
    i, j = np.nonzero(beyond <= far)
    return i, j, own[i]


def _beyond(x: np.ndarray, c: np.ndarray, own: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The distance of each row of x from the border between its own cell and another; the same wherever it is computed."""
    d = c[own] - c[cell]
    return (x * d).sum(1) / np.maximum(np.sqrt((d * d).sum(1)), 1e-6)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, of 32-bit numbers where those are exact."""
    with np.errstate(over="ignore"):
        low = x.astype("<f4")
    exact = (low == x).all(1)
    return [a.tobytes() if e else b.tobytes() for a, b, e in zip(low, x.astype("<f8"), exact, strict=True)]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8") for r in rows]).astype(np.float64)


def _place(sent, dim: int, far: float):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                size = np.array([len(v) for v in part.column(1)])
                main = np.flatnonzero(size == dim)
                i, cell, own, data = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.empty(part.num_rows, object)
                if len(main):
                    x = part.column(1).take(pa.array(main)).flatten().to_numpy().reshape(-1, dim)
                    data[main] = _packed(x)
                    i, cell, own = cells_of(_unit(x), sent.value, far)
                    i = main[i]
                rest = np.flatnonzero(size != dim)  # another length: a cell for each
                for k in rest:
                    data[k] = _packed(part.column(1)[int(k)].values.to_numpy()[None])[0]
                i, cell, own = np.concatenate([i, rest]), np.concatenate([cell, -size[rest]]), np.concatenate([own, -size[rest]])
                take = pa.array(i)
                cols = [part.column(0).take(take), pa.array([data[k] for k in i], pa.binary()), part.column(2).take(take), pa.array(cell.astype(np.int32)), pa.array(own.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["gid", "vec", "m", "cell", "home"])

    return run


def _compare(sent, dim: int, threshold: float):
    """In one pair of blocks of a cell: for each vector how many others link with it, and links that join what links.

    A pair on two sides of a border may be met in both cells: it counts in the lower one if both vectors reach over.
    """
    near = reach(threshold) + SLACK / 2

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, j, cell = (t.column(n)[0].as_py() for n in ("i", "j", "cell"))
        d = dim if cell >= 0 else -cell
        gid, m, blk, home = t.column("gid").to_pylist(), *(t.column(n).to_numpy() for n in ("m", "block", "home"))
        x = _unit(_unpacked(t.column("vec").to_pylist(), d))
        quick = x.astype(np.float32)
        least = threshold - 2e-7 * (d + 16)  # no product of single precision is further off
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        count, a, b = np.zeros(len(m), np.int64), [], []
        for s in range(0, len(left), AT_ONCE):
            rows = left[s : s + AT_ONCE]
            p, q = np.nonzero(quick[rows] @ quick[right].T >= least)
            p, q = rows[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            keep = np.zeros(len(p), bool)
            for k in range(0, len(p), 1 << 16):
                keep[k : k + (1 << 16)] = (x[p[k : k + (1 << 16)]] * x[q[k : k + (1 << 16)]]).sum(1) >= threshold
            p, q = p[keep], q[keep]
            guest = home[q] != cell  # the left block is never one of guests
            if guest.any():
                c = sent.value
                g = np.flatnonzero(guest)
                here = np.full(len(g), cell)
                fine = _beyond(x[q[g]], c, home[q[g]], here) <= near
                fine &= ~((home[q[g]] < cell) & (_beyond(x[p[g]], c, here, home[q[g]]) <= near))
                keep = ~guest
                keep[g] = fine
                p, q = p[keep], q[keep]
            np.add.at(count, p, m[q])
            np.add.at(count, q, m[p])
            a.append(p)
            b.append(q)
            if sum(map(len, a)) > 8 * len(m):  # links already joined are forgotten
                root = roots(np.concatenate(a), np.concatenate(b), len(m))
                a, b = [np.flatnonzero(root != np.arange(len(m)))], [root[root != np.arange(len(m))]]
        root = roots(np.concatenate(a), np.concatenate(b), len(m)) if a else np.arange(len(m))
        told = np.flatnonzero((count > 0) | (root != np.arange(len(m))))
        return pa.table({"gid": pa.array([gid[k] for k in told], pa.string()), "n": pa.array(count[told], pa.int64()), "root": pa.array([gid[root[k]] for k in told], pa.string())})

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.95, cell: int = CELL, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Vectors link if their cosine is at least threshold.

    Equal vectors are collapsed to one with a multiplicity, by two 64-bit hashes. Centroids are fitted on SAMPLE vectors
    at most, with the least hashes, a sixteenth as many at most; every vector is placed in the cell of the nearest
    centroid, and visits each cell whose border is within reach(threshold): one vector of any link across that border
    does, so no link is lost, whatever the vectors are like. Cells are cut into blocks, and each pair of blocks is one
    bounded product, in single precision with room for its error and then in double, so a cell of any size is many
    tasks. A pair of blocks gives out counts and at most one link per vector, never all pairs; the representative kept of
    a component is its smallest id.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing and stay. Vectors of unequal
    length don't link. Rows that repeat an id count as vectors of their own. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    raw = F.col(f"`{vec_col}`").cast("array<double>")
    fine = raw.isNotNull() & F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists(raw, lambda v: v != 0)
    rows = narrow(vectors, id=id_col, vec=F.when(fine, raw))
    name = F.concat(F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vec")))
    rows = cut_lineage(rows.withColumn("gid", F.when(F.col("vec").isNotNull(), name)))
    total = rows.count()
    groups = cut_lineage(rows.filter("gid IS NOT NULL").groupBy("gid").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("m"), F.min("id").alias("lead")))
    sizes = groups.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (sizes["d"], sizes["count"]) if sizes else (1, 0)
    sample = groups.filter(F.size("vec") == dim).orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("vec").toArrow() if n else None
    centroids = fit_cells(_unit(sample["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)), max(1, min(n // cell, SAMPLE // 16))) if n else np.ones((1, 1))
    kind = rows.schema["id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(centroids)
    placed = cut_lineage(map_arrow(groups.select("gid", "vec", "m"), _place(sent, dim, reach(threshold) + SLACK), "gid string, vec binary, m long, cell int, home int"))
    own = F.col("home") == F.col("cell")
    part = lambda mine: F.ceil(F.count_if(own if mine else ~own) / block).cast("int")
    blocks = placed.groupBy("cell").agg(F.greatest(part(True), F.lit(1)).alias("inner"), part(False).alias("outer"))  # a cell's own vectors, then its guests
    dealt = placed.join(F.broadcast(blocks), "cell")  # a row for each cell
    deal = F.xxhash64("gid", "cell")
    dealt = dealt.withColumn("block", F.when(own, F.pmod(deal, F.col("inner"))).otherwise(F.col("inner") + F.pmod(deal, F.col("outer"))).cast("int"))
    last = F.when(own, F.col("inner") + F.col("outer")).otherwise(F.col("inner")) - 1  # two guests aren't compared
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    pairs = pairs.select("gid", "vec", "m", "cell", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = cut_lineage(pairs.groupBy("cell", "i", "j").applyInArrow(_compare(sent, dim, threshold), "gid string, n long, root string"))
    label = connected_components(found.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("gid").agg(F.sum("n").alias("n"))
    named = groups.drop("vec").join(links, "gid", "left").join(label, groups["gid"] == label["node"], "left")
    named = named.select(groups["gid"], "m", "lead", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", groups["gid"]).alias("label"))
    least = named.groupBy("label").agg(F.min("lead").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    named = spread_join(named, least, "label", "__n", max(1, n)).select(F.col("gid").alias("gid"), (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id", F.col("m").alias("__m"))
    known = spread_join(rows.filter("gid IS NOT NULL").select("id", "gid"), named, "gid", "__m", total).select("id", "n_links", "component_id")
    other = rows.filter("gid IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast(kind).alias("component_id"))
    return known.unionByName(other).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
