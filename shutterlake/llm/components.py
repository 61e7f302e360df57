"""Connected components by alternating large-star and small-star steps; every step is distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import cut_lineage, roots, spread_join

#: Links between long numbers, two of eight bytes each, up to which the driver finds the components itself: 4 MB.
LOCAL_LINKS = 1 << 18


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """Each pair (u, v) with the smallest v of u, as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
    return spread_join(pairs, least, "u", "__n", total).drop("__n")


def _here(edges: DataFrame) -> DataFrame:
    """The components of few links, found on the driver: no rounds, whose tasks and plans the driver would remember."""
    t = edges.toArrow()
    nodes, at = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
    label = nodes[roots(at[: t.num_rows], at[t.num_rows :], len(nodes))]
    return cut_lineage(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "label": label})))


def connected_components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """For links (a, b), undirected, one row (node, label) per linked node; label is the smallest node it reaches.

    Works with any ordered type. Self-links and repeated links don't matter; rows with a null are left out; no links
    give no rows. A node with a large share of the links is spread, not gathered. Each round writes the links to the
    checkpoint folder; the number of rounds grows as the logarithm of the longest chain. As soon as no more than local
    links between longs are left, the driver ends the work.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut_lineage(edges.distinct())
    state, small_type = None, edges.schema["u"].dataType.simpleString() == "bigint"
    while True:
        total, check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (total, check) == state or not total:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        if small_type and total <= local:
            return _here(edges)
        state = (total, check)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _star(large, 2 * total)
        edges = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v"), F.col("m"))).distinct()
        edges = cut_lineage(edges)
