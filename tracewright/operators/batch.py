"""Batch algebra on rows that carry a position from 0: chunks, padding, slices, repeats, folds, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, times: int | Column, to: str = "rep") -> DataFrame:
    """Each row as often as ``times`` says (0 or less: not at all), numbered from 1; the order by (row, rep) interleaves, by (rep, row) stacks."""
    n = times if isinstance(times, Column) else F.lit(times)
    return df.where(n > 0).withColumn(to, F.explode(F.sequence(F.lit(1), n.cast("int"))))


def chunk(pos: str, n: int, k: int) -> Column:
    """Which of k equal chunks of n rows a position is in; n must divide evenly."""
    if n % k:
        raise ValueError(f"{n} rows don't make {k} equal chunks")
    return F.floor(F.col(pos) / (n // k))


def shard(pos: str, n: int, world: int) -> Column:
    """Contiguous shards of ceil(n / world) rows; the last ones may be short or empty."""
    return F.floor(F.col(pos) / F.lit(max(1, -(-n // world))))


def padded(df: DataFrame, pos: str, n: int, divisor: int) -> DataFrame:
    """Rows and, to make a multiple of ``divisor``, the leading rows again (round and round if there are too few)."""
    short = -n % divisor if n else 0
    rounds = -(-short // n) if n else 0
    again = repeated(df, rounds, "_round") if rounds else df.limit(0).withColumn("_round", F.lit(1))
    again = again.withColumn(pos, F.col(pos) + n * F.col("_round")).where(F.col(pos) < n + short).drop("_round")
    return df.unionByName(again)


def unpadded(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.where(F.col(pos) < n)


def sliced(df: DataFrame, pos: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop."""
    at = F.col(pos)
    return df.where((at >= start) & (at < stop) & ((at - start) % step == 0))


def folded(df: DataFrame, pos: str, size: int, *columns: str) -> DataFrame:
    """One row for each block of ``size`` rows, with lists in order."""
    rows = df.groupBy(F.floor(F.col(pos) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(pos, *columns))).alias("_rows"))
    return rows.select("block", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def unfolded(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """The inverse of ``folded``: a row for each place of the lists."""
    zipped = df.select("block", F.posexplode(F.arrays_zip(*columns)).alias("_at", "_row"))
    return zipped.select((F.col("block") * size + F.col("_at")).alias("pos"), *[F.col(f"_row.{c}").alias(c) for c in columns])


def zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both sides by row key; columns that both have are taken once, and told apart by ``same``.

    ``same`` is false where a shared column differs, so that a caller can reject the batch without collecting it.
    """
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    out = left.join(r, key)
    same = F.lit(True)
    for c in shared:
        same &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return out.withColumn("same", same).drop(*[f"_r_{c}" for c in shared])


def required(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no column {missing}")
    return df.select(*columns)


def weights_for_resampling(score: Column, method: str = "pow", power: float = 2.0, low: Column | None = None, high: Column | None = None) -> Column:
    """Positive weights: |score|**power; or 1 for the batch's extreme scores and 0 for others; or 0.4 for the best and 0.1 for others."""
    if method == "pow":
        weight = F.pow(F.abs(score), F.lit(power))
    elif method == "max_min":
        weight = F.when((score == high) | (score == low), 1.0).otherwise(0.0)
    elif method == "max_random":
        weight = F.when(score == high, 0.4).otherwise(0.1)
    else:
        raise ValueError(method)
    return F.greatest(weight + 1e-8, F.lit(1e-8))


def resampled(df: DataFrame, weight: str, key: str, seed: object = 42) -> DataFrame:
    """As many rows as ``df`` has, drawn with replacement by weight: each draw is a hashed point on the line of weights.

    Rows own spans of the running sum of weights in order of a hash of their key, which deals them out in parts; a draw
    falls to the last span that starts before it in its part of the line. Parts are cut fine enough to be sorted in a
    task; of each part only a row is broadcast. ``key`` must be unique; null and negative weights count for nothing.
    """
    from pyspark.sql import Window

    from tracewright.operators.order import in_cells, seeded

    h = seeded(key, seed=seed)
    rows = df.select(key, F.coalesce(F.col(weight), F.lit(0.0)).alias("_w"), h.alias("_h"), F.conv(F.substring(h, 1, 3), 16, 10).cast("int").alias("_part")).where("_w > 0")
    parts = rows.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_start", F.sum("_sum").over(ends) - F.col("_sum"))
    known = sorted((r["_start"], r["_part"], r["_sum"]) for r in parts.collect() if r["_sum"] > 0)  # 4096 at most
    if not known:
        return df.limit(0)
    total = known[-1][0] + known[-1][2]
    inside = Window.partitionBy("_part").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    starts = df.sparkSession.createDataFrame([(p, s) for s, p, _ in known], "_part int, _start double")
    spans = rows.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.sum("_w").over(inside) - F.col("_w")).select("_part", "_at", F.col(key).alias("_k"))
    u = (F.conv(F.substring(seeded(key, seed=f"draw-{seed}"), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    draws = in_cells(df.select((u * F.lit(total)).alias("_at")), "_at", [s for s, _, _ in known[1:]], "_cell")
    place = F.array(*[F.lit(p) for _, p, _ in known])
    draws = draws.select(place[F.col("_cell")].alias("_part"), "_at", F.lit(None).cast(df.schema[key].dataType).alias("_k"))
    both = spans.withColumn("_draw", F.lit(0)).unionByName(draws.withColumn("_draw", F.lit(1)))
    before = Window.partitionBy("_part").orderBy("_at", "_draw").rowsBetween(Window.unboundedPreceding, 0)
    drawn = both.withColumn("_k", F.last("_k", ignorenulls=True).over(before)).where("_draw = 1").groupBy("_k").agg(F.count("*").cast("int").alias("_n"))
    out = df.join(drawn, F.col(key) == F.col("_k")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.drop("_k", "_n")
