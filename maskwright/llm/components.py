"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by on narrow rows; each round is written to the shared folder, so the
plan stays short and a lost executor costs one round at most. Rounds grow with the logarithm
of the longest path. Neighbour lists are never collected: minima are aggregated and joined
back, so a vertex of very high degree is no task's burden.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import lean, persist

#: Edges, of 16 bytes, up to which one task settles all; counted before.
SMALL = 2_000_000


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets that hold a[i] and b[i]; label ends flat, at the least member."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label[:] = flat


@lean
def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, root) of all edges at hand."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(names))
        unite(label, at[: len(u)], at[len(u) :])
        for a in range(0, len(names), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + (1 << 16)]), pa.array(names[label[a : a + (1 << 16)]])], ["vertex", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each vertex to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of each vertex, and the vertex, to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v")
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u long, v long): root is the least vertex
    reachable, the vertex itself included. Loops and repeated edges are harmless; an empty
    table gives an empty result.

    Up to SMALL edges are united by one task. Otherwise: the edges form stars, which is the end, when no vertex is
    both a parent and a child and every child has one parent. Neither step adds edges.
    """
    current = persist(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v"), "cc")
    if current.count() <= SMALL:
        return persist(current.repartition(1).mapInArrow(_at_once, "vertex long, root long"), "roots")
    current = persist(current.distinct(), "cc")
    for _ in range(max_rounds):
        parents = current.select(F.col("u").alias("v")).distinct()
        unfinished = (
            current.join(parents, "v", "left_semi").limit(1).count()
            or current.groupBy("v").count().where("count > 1").limit(1).count()
        )
        if not unfinished:
            break
        current = persist(_small_star(_large_star(current)), "cc")
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("u").alias("vertex"), F.col("u").alias("root")).distinct()
    return roots.unionByName(current.select(F.col("v").alias("vertex"), F.col("u").alias("root")))
