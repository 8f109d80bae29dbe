"""Work of a batch by ranks: each rank gets an equal run of rows, or all of them, and the order comes back.

Rows are numbered in order of a key; rank r of w gets rows r n/w to (r+1) n/w. Where w doesn't divide n, rows from the
front are repeated at the end and their results dropped, so that each rank has as many. A rank's rows reach its function
as frames, in order, and are never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.operators.order import numbered

Work = Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def to_ranks(df: DataFrame, key: str, workers: int, pad: bool = True, *ties: str) -> DataFrame:
    """``df`` with pos, rank and padded: rows in order of ``key``, in equal runs for each of ``workers`` ranks.

    Without ``pad`` a number of rows that ``workers`` doesn't divide is an error. With fewer rows than ranks rows are
    repeated as often as it takes. Columns of the names added are replaced; an empty table stays empty.
    """
    if workers < 1:
        raise ValueError("there must be a rank at least")
    placed = numbered(df.drop("pos", "rank", "padded"), key, *ties)
    n = df.count()
    missing = -n % workers
    if missing and not pad:
        raise ValueError(f"{n} rows don't divide among {workers} ranks")
    whole = placed.withColumn("padded", F.lit(False))
    if n and missing:
        # Rows from the front go to places n, n + 1 and on, going round while there are places left.
        rounds = F.sequence(F.lit(n), F.lit(n + missing - 1), F.lit(n)) if missing > n else F.array(F.lit(n))
        again = placed.where(F.col("pos") < missing).withColumn("_from", F.explode(rounds)).withColumn("pos", F.col("pos") + F.col("_from")).drop("_from")
        whole = whole.unionByName(again.where(F.col("pos") < n + missing).withColumn("padded", F.lit(True)))
    return whole.withColumn("rank", F.floor(F.col("pos") / max(1, (n + missing) // workers)).cast("int"))


def dispatched(df: DataFrame, key: str, workers: int, work: Work, schema: str, pad: bool = True, *ties: str) -> DataFrame:
    """The results of ``work`` on each rank's rows, in frames of as many rows, with ``pos`` of the input; those of padding go.

    ``work`` gets the rank and its frames, with the columns of ``df``, and gives a frame of ``schema`` for each, row for
    row. Sort by ``pos`` for the order of the input.
    """
    columns = [c for c in df.columns if c not in ("pos", "rank", "padded")]
    ranked = to_ranks(df, key, workers, pad, *ties).repartition(workers, "rank").sortWithinPartitions("rank", "pos")
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (part for frame in frames for _, part in frame.groupby("rank", sort=False) if len(frame))
        for rank, mine in groupby(parts, key=lambda p: int(p["rank"].iloc[0])):
            marks: list[pd.DataFrame] = []

            def given() -> Iterator[pd.DataFrame]:
                for part in mine:
                    marks.append(part[["pos", "padded"]].reset_index(drop=True))
                    yield part[columns].reset_index(drop=True)

            for out in work(rank, given()):
                mark = marks.pop(0)
                if len(out) != len(mark):
                    raise ValueError(f"rank {rank}: {len(out)} results of {len(mark)} rows")
                yield pd.concat([mark[["pos"]], out[names].reset_index(drop=True)], axis=1)[~mark["padded"].to_numpy()]

    return ranked.mapInPandas(run, f"pos long, {schema}")


def to_all(df: DataFrame, workers: int) -> DataFrame:
    """Every row at every rank (one-to-all): ``df`` with rank, replaced if there."""
    return df.drop("rank").withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


def reduced(df: DataFrame, by: list[str], how: dict[str, str]) -> DataFrame:
    """What ranks gave, as one: sum, mean, min, max or first rank's value of each column in ``how``."""
    kinds = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "first": lambda c: F.min_by(c, "rank")}
    return df.groupBy(*by).agg(*[kinds[k](c).alias(c) for c, k in how.items()])
