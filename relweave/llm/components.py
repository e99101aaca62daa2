"""Connected components of a link table.

Few links, counted first, fit one task by their number (``LOCAL_LINKS`` rows of two ids) and are joined there in
arrays.  More are joined by alternating star contraction over all tasks: each round points every node's larger neighbours, then its smaller ones, at the least
node it knows.  The number of rounds grows with the logarithm of a component's size.
Only grouping with map-side combine and plain joins are used, so a hub's links are
never gathered in one task; a round's links are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.store import stored

ROUNDS = 60
LOCAL_LINKS = 500_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links of one task: every link pulls both ends' roots to the lesser, then paths are cut short."""
    tables = list(batches)
    if not tables:
        return
    kind = tables[0].column(0).type
    a, b = (np.concatenate([t.column(k).to_numpy(zero_copy_only=False) for t in tables]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, x, y)
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, type=kind), pa.array(nodes[root], type=kind)], ["node", "component"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v).  large: every neighbour above u moves to u's least; else those below u and u itself."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        below = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        moved = below.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node.

    Self links and nulls are ignored; an empty table gives an empty one.
    """
    known = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v")
    if known.count() <= LOCAL_LINKS:
        kind = links.schema["a"].dataType
        return known.coalesce(1).mapInArrow(_local, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    now = stored(known.distinct(), "stars")
    last = None
    for _ in range(ROUNDS):
        now = stored(_star(_star(now, True), False), "stars")
        # a forest of stars no longer changes
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        last = tuple(state)
    raise RuntimeError(f"components still change after {ROUNDS} rounds")
