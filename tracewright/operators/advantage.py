"""Group statistics and advantage estimators over rows (uid, score), as grouped aggregates joined back.

Groups of one prompt are small, but a group key may be hot in other uses, so statistics are computed by partial
aggregation and joined back rather than by windows that hold a group in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6


def with_stats(df: DataFrame, score: str = "score", by: str = "uid", floor: float | None = None) -> DataFrame:
    """Adds n, mean and deviation of the group: 0 and 1 for a single row; with ``floor``, variances are floored instead."""
    s = df.groupBy(by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.var_samp(score).alias("_var"))
    if floor is None:
        deviation = F.when(F.col("n") == 1, 1.0).otherwise(F.sqrt("_var"))
        s = s.withColumn("mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("mean")))
    else:
        s = s.withColumn("mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("mean")))
        deviation = F.when(F.col("n") == 1, 1.0).otherwise(F.sqrt(F.greatest("_var", F.lit(floor))))
    return df.join(s.withColumn("deviation", deviation).drop("_var"), by)


def grpo(df: DataFrame, score: str = "score", by: str = "uid", normalize: bool = True) -> DataFrame:
    d = with_stats(df, score, by)
    centred = F.col(score) - F.col("mean")
    return d.withColumn("advantage", centred / (F.col("deviation") + EPSILON) if normalize else centred)


def grpo_floored(df: DataFrame, score: str = "score", by: str = "uid") -> DataFrame:
    d = with_stats(df, score, by, floor=EPSILON)
    return d.withColumn("advantage", (F.col(score) - F.col("mean")) / (F.col("deviation") + EPSILON))


def grpo_passk(df: DataFrame, score: str = "score", by: str = "uid", order: str = "row_id") -> DataFrame:
    """Only a group's best row gets a value, its lead over the second; ties go to the first row. One row has no lead."""
    best = F.max_by(order, F.struct(score, F.negative(order))).alias("_best")
    s = df.groupBy(by).agg(best, F.max(score).alias("_first"), F.var_samp(score).alias("_var"), F.count("*").alias("n"))
    second = df.join(s.select(by, "_best"), by).where(F.col(order) != F.col("_best")).groupBy(by).agg(F.max(score).alias("_second"))
    d = df.join(s, by).join(second, by, "left")
    lead = (F.col("_first") - F.col("_second")) / (F.sqrt("_var") + EPSILON)
    return d.withColumn("advantage", F.when(F.col(order) == F.col("_best"), lead).otherwise(F.when(F.col("n") > 1, 0.0)))


def rloo(df: DataFrame, score: str = "score", by: str = "uid", single: str = "score") -> DataFrame:
    """Score less the mean of the group's other rows; a single row passes its score, or 0."""
    s = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    rest = F.try_divide((F.col(score) - F.col("mean")) * F.col("n"), F.col("n") - 1)
    alone = F.col(score) if single == "score" else F.lit(0.0)
    return df.join(s, by).withColumn("advantage", F.when(F.col("n") > 1, rest).otherwise(alone))


def opo(df: DataFrame, score: str = "score", length: str = "length", by: str = "uid") -> DataFrame:
    """Score less the group's mean weighted by length."""
    s = df.groupBy(by).agg((F.sum(F.col(score) * F.col(length)) / F.sum(length)).alias("base"))
    return df.join(s, by).withColumn("advantage", F.col(score) - F.col("base"))


def gpg(df: DataFrame, score: str = "score", by: str = "uid", norm: float = 1.0) -> DataFrame:
    """Centred scores, scaled by rows over rows that score something."""
    total = df.agg(F.count("*").alias("_rows"), F.count_if(F.col(score) != 0).alias("_some"))
    d = with_stats(df, score, by).crossJoin(F.broadcast(total))
    return d.withColumn("advantage", F.col("_rows") / F.greatest("_some", F.lit(1)) * (F.col(score) - F.col("mean")) / norm)


#: Estimators by name.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {"grpo": grpo, "grpo_vectorized": grpo_floored, "grpo_passk": grpo_passk, "rloo": rloo, "opo": opo, "gpg": gpg}


def kept_groups(df: DataFrame, score: str = "acc", by: str = "uid", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows of groups whose mean is strictly between the bounds, and of groups of one."""
    s = df.groupBy(by).agg(F.avg(score).alias("_m"), F.count("*").alias("_n")).where((F.col("_m") > low) & (F.col("_m") < high) | (F.col("_n") == 1))
    return df.join(s.select(by), by, "left_semi")


def kl_masks(mean: Column, threshold: float, zero: float = 0.01) -> tuple[Column, Column]:
    return F.when(mean > threshold, 0.0).otherwise(1.0), F.when(mean < zero, 0.0).otherwise(1.0)
