"""Connected components by alternating large-star and small-star.

Every step is a grouped minimum, a join and a distinct, all over edges that Spark deals out by key; neither
neighbour lists nor labels are ever collected. Minima are combined before the shuffle. A node with very many
neighbours would be one key of the join: the minima of such nodes, whose number is bounded, are broadcast instead.
Before the first step, tasks of a bounded number of edges each join what they can see, so that few rounds are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import checkpointed, join_totals


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins places under links in place; each points to the least place of its tree."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root[:] = higher


def _contracted(edges: DataFrame, n: int, each: int) -> DataFrame:
    """Edges with the same components: of ``each`` edges, a node and the least node that they join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if held:
            u, v = (np.concatenate(side) for side in zip(*held))
            nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = np.arange(len(nodes))
            join_roots(root, place[: len(u)], place[len(u) :])
            low = root < np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[root[low]])], names=["u", "v"])

    return edges.repartition(max(1, -(-n // each))).mapInArrow(run, "u long, v long")


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v), ``n`` at most, each with m, the least v of its u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_totals(rows, least, "u", n)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))  # repeats go in the other step


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges have u > v here."""
    met = _with_least(edges, n)
    kept = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionAll(met.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, most_rounds: int = 60, each: int = 1 << 20) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge.

    ``edges`` has two long columns, in any direction; loops, repeats and nulls are ignored. An empty table gives
    an empty result. The rounds needed grow with the logarithm of the longest chain.
    """
    a, b = edges.columns[:2]
    edges = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v"))
    edges = checkpointed(_contracted(edges, edges.count(), each))
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = checkpointed(_small_star(_large_star(edges, state[0]), state[0]))
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
