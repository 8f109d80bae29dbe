"""Exact nearest vectors of a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _units(column: pa.Array, size: int) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors.to_pylist()], int)
    out = {}
    for size in np.unique(sizes).tolist():
        mine = pa.array(np.flatnonzero(sizes == size))
        out[size] = ids.take(mine).to_numpy(zero_copy_only=False), _units(vectors.take(mine), size)
    return out


def _top(ids: np.ndarray, x: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, width: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, cosine) of each query's k best, by score, then id; vectors are met in slices, a running top k is kept."""
    row, found, score = np.zeros(0, np.int64), np.zeros(0, vid.dtype), np.zeros(0)
    for at in range(0, len(vid), width):
        mine = vid[at : at + width]
        c = x @ v[at : at + width].T
        c[ids[:, None] == mine[None, :]] = -np.inf
        # All that reach a slice's k-th score, so that ties are not cut off by chance.
        least = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(c), -np.inf)
        new, place = np.nonzero((c >= least[:, None]) & np.isfinite(c))
        row, found, score = np.concatenate([row, new]), np.concatenate([found, mine[place]]), np.concatenate([score, c[new, place]])
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        row, found, score = row[keep], found[keep], score[keep]
    return row, found, score


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048, portion: int = 65_536) -> DataFrame:
    """(query_id, vec_id, rank): the k vectors of greatest cosine of each query, itself left out; ties by id.

    Both sides are (id, array). Vectors that are null, empty or zero, or hold null or non-finite components, neither
    ask nor answer, and only vectors of one length meet. Queries are a table of blocks in the folder that executors
    share, never in the driver; vectors are read once, and each portion of a task meets block after block. A portion
    gives a top k of each query, so what is shuffled grows with queries and portions, not with pairs.
    """
    from tracewright.streaming.place import shared_dir

    spark, root = vectors.sparkSession, shared_dir(vectors.sparkSession)
    slim = lambda df: df.select(F.col(df.columns[0]).cast("long").alias("id"), F.col(df.columns[1]).cast("array<double>").alias("v")).where(valid(F.col("v")) & F.col("id").isNotNull())
    q = slim(queries)
    q.repartition(max(1, -(-q.count() // block))).write.parquet(root)
    blocks = spark.read.parquet(root).inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        def best(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            sides = _by_length(t.column(0).combine_chunks(), t.column(1).combine_chunks())
            for uri in blocks:
                store, path = fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")
                asked = pq.read_table(store.open_input_file(path))
                if not asked.num_rows:
                    continue
                for size, (ids, x) in _by_length(asked.column(0).combine_chunks(), asked.column(1).combine_chunks()).items():
                    if size not in sides:
                        continue
                    row, vid, score = _top(ids, x, *sides[size], k)
                    yield pa.RecordBatch.from_pydict({"query_id": ids[row], "vec_id": vid, "c": score})

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= portion:
                yield from best(held)
                held, n = [], 0
        if n:
            yield from best(held)

    out = slim(vectors).mapInArrow(run, "query_id long, vec_id long, c double")
    w = Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank")
