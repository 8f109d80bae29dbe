"""Balanced parts of a block of sequences; blocks are of bounded size and packed side by side."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_loads(df: DataFrame, by: list[str], weight: str, order: str, bins: int) -> DataFrame:
    """Loads after giving each block's rows, in order, each to the least loaded bin (the first of equals)."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, weight))).alias("rows"))
    start = F.array(*[F.lit(0) for _ in range(bins)]).cast("array<int>")

    def give(load, row):
        least = F.array_position(load, F.array_min(load))
        return F.transform(load, lambda b, i: F.when(i + 1 == least, b + row[weight]).otherwise(b))

    return rows.select(*by, F.aggregate("rows", start, give).alias("bins"))


def differenced(weights: list[int], parts: int, equal: bool) -> list[list[int]]:
    """Places of the weights in each part, by largest differencing; with ``equal``, all parts get as many.

    Partial divisions wait in a heap by their spread. The two widest are merged, the heaviest part of one with the
    lightest of the other, until one is left.
    """
    if equal and len(weights) % parts:
        raise ValueError("weights don't divide evenly")

    def entry(groups: list[tuple[int, list[int]]], tie: int) -> tuple:
        groups.sort(key=lambda g: (-g[0], g[1]))
        return groups[-1][0] - groups[0][0], tie, groups

    order = sorted(range(len(weights)), key=lambda i: (weights[i], i))
    step = parts if equal else 1
    heap = []
    for k in range(0, len(order), step):
        groups = [(weights[i], [i]) for i in order[k : k + step]] + [(0, []) for _ in range(parts - step)]
        heap.append(entry(groups, k))
    heapq.heapify(heap)
    tie = len(order)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        tie += 1
        heapq.heappush(heap, entry([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))], tie))
    return [sorted(p) for _, p in heap[0][2]] if heap else [[] for _ in range(parts)]


def karmarkar_karp(df: DataFrame, by: str, weight: str, order: str, parts: int, equal: bool = False) -> DataFrame:
    """(by, row, weight, bin): each block's rows in ``parts`` parts of about equal weight."""
    kinds = dict(df.dtypes)

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(order)
        even = equal and len(block) % parts == 0
        where = {i: k for k, part in enumerate(differenced(block[weight].astype("int64").tolist(), parts, even)) for i in part}
        return pd.DataFrame({by: block[by], order: block[order], "weight": block[weight].astype("int64"), "bin": [where[i] for i in range(len(block))]})

    return df.select(by, order, weight).groupBy(by).applyInPandas(pack, f"{by} {kinds[by]}, {order} {kinds[order]}, weight long, bin int")
