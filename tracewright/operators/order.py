"""Positions and seeded orders without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(*columns: str, seed: object = 42) -> Column:
    """A pseudo-random sort key that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


#: The most ranges that positions are counted in: what is broadcast has a row for each.
MOST_CELLS = 4096


def quantiles(df: DataFrame, key: str, cells: int) -> list[float]:
    found = df.select(F.col(key).cast("double").alias("k")).where("k is not null").approxQuantile("k", [i / cells for i in range(1, cells)], 1 / (8 * cells))
    return sorted({v for v in found if v == v and abs(v) != float("inf")})


def in_cells(df: DataFrame, key: str, bounds: list[float], to: str) -> DataFrame:
    """Numbers the range a key falls into; nulls are in -1, NaN in the last."""
    from pyspark.ml.feature import Bucketizer

    infinity = float("inf")
    keyed = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(-infinity)))
    cut = Bucketizer(splits=[-infinity, *bounds, infinity], inputCol="_key", outputCol=to, handleInvalid="keep")
    return cut.transform(keyed).drop("_key").withColumn(to, F.when(F.col(key).isNull(), -1).otherwise(F.col(to).cast("int")))


def numbered(df: DataFrame, key: str, *ties: str, to: str = "pos", each: int = 100_000) -> DataFrame:
    """Adds each row's position from 0 in order of a numeric key, then ``ties``; null keys come first.

    Rows fall into ranges of about ``each`` rows between quantiles of the key. A range's rows are numbered in one task
    each and start where the counts of the ranges before end. A key that fills more than two ranges alone is cut by
    quantiles of the first tie, if that is numeric. ``df`` is read several times; of a small table there is one range.
    """
    cells = min(MOST_CELLS, -(-df.count() // each))
    order = [F.asc_nulls_first(key), *ties]
    if cells <= 1:
        return _numbered(df.withColumn("_cell", F.lit(0)), ["_cell"], order, to)
    df = in_cells(df, key, quantiles(df, key, cells), "_cell")
    numeric = ties and dict(df.dtypes)[ties[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    stats = df.groupBy("_cell").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    crowded = stats.where(F.col("low").eqNullSafe(F.col("high")) & (F.col("n") > 2 * each)).collect() if numeric else []
    sub = F.lit(0)
    for row in crowded:
        inside = df.where(F.col("_cell") == row["_cell"])
        bounds = quantiles(inside, ties[0], min(MOST_CELLS, -(-row.n // each)))
        above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda v: v <= F.col(ties[0]).cast("double"))) if bounds else F.lit(0)
        sub = F.when(F.col("_cell") == row["_cell"], F.greatest(above, F.lit(0))).otherwise(sub)
    return _numbered(df.withColumn("_sub", sub), ["_cell", "_sub"], order, to)


def numbered_by_hash(df: DataFrame, hex_key: str, *ties: str, to: str = "pos", each: int = 100_000) -> DataFrame:
    """The same in order of a hexadecimal digest, whose first digits deal out rows evenly, about ``each`` to a range.

    ``df`` is read to be counted; up to five digits are used, a million ranges.
    """
    n, digits = df.count(), 0
    while 16**digits * each < n and digits < 5:
        digits += 1
    cell = F.conv(F.substring(hex_key, 1, digits), 16, 10).cast("int") if digits else F.lit(0)
    return _numbered(df.withColumn("_cell", cell), ["_cell"], [hex_key, *ties], to, few=16**digits <= MOST_CELLS)


def _numbered(df: DataFrame, cells: list[str], order: list, to: str, few: bool = True) -> DataFrame:
    counts = df.groupBy(*cells).count()
    before = Window.orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cells, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    rows = df.withColumn("_row", F.row_number().over(Window.partitionBy(*cells).orderBy(*order)))
    return rows.join(F.broadcast(starts) if few else starts, cells).withColumn(to, F.col("_start") + F.col("_row") - 1).drop(*cells, "_row", "_start")


def ranked(df: DataFrame, by: str, order: list, cells: dict[str, Column], to: str = "pos") -> DataFrame:
    """Adds each row's position from 0 within its ``by`` in order; of a key with very many rows no task holds all.

    ``cells`` are columns that grow with the order: a key's rows of one cell are numbered together and start where the
    counts of its cells before end.
    """
    columns, df = df.columns, df.withColumns(cells)
    keys = [by, *cells]
    before = Window.partitionBy(by).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rows = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return _met(rows, starts, keys).select(*columns, (F.col("_start") + F.col("_row") - 1).alias(to))


def running(df: DataFrame, by: str, value: str, order: list, cells: dict[str, Column], to: str = "sum") -> DataFrame:
    """Adds the sum of ``value`` over a row and those before it within its ``by``; nulls add nothing. ``cells`` as in ``ranked``."""
    columns, df = df.columns, df.withColumns(cells)
    keys = [by, *cells]
    before = Window.partitionBy(by).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _met(rows, starts, keys).select(*columns, (F.col("_start") + F.col("_run")).alias(to))


def _met(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their range's start; a null key meets itself."""
    starts = starts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return rows.join(starts, same)


def first_n(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in order: a partial top-n in each task, then one of n rows each."""
    return df.orderBy(*order).limit(n)


def latest(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
