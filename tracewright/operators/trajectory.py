"""Filters, cleaning rules, history windows and splits of trajectories (one row a step, keyed by episode and step).

Episodes are short by rule (at most 40 steps), so windows over an episode hold little at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.order import seeded

EPISODE = ("episode_id",)
MAX_STEPS = 40


def usable() -> Column:
    """is_use counts as true and is_delete as false where missing."""
    return F.coalesce("is_use", F.lit(True)) & ~F.coalesce("is_delete", F.lit(False))


def within(*, before: int | None = None, after: int | None = 0, key: tuple[str, ...] = EPISODE, order: str = "step"):
    start = Window.unboundedPreceding if before is None else -before
    end = Window.unboundedFollowing if after is None else after
    return Window.partitionBy(*key).orderBy(order).rowsBetween(start, end)


def step_line(offset: int | Column = 0, text: str = "action") -> Column:
    return F.concat(F.lit("Step "), (F.col("step") + offset).cast("string"), F.lit(": "), F.coalesce(F.col(text), F.lit("")), F.lit(";"))


def history(df: DataFrame, line: Column, to: str = "history", separator: str = " ") -> DataFrame:
    """Adds the joined lines of all earlier steps of the episode, used or not; empty at the first."""
    return df.withColumn("_line", line).withColumn(to, F.array_join(F.collect_list("_line").over(within(after=-1)), separator)).drop("_line")


def episode_facts(df: DataFrame) -> DataFrame:
    """One row an episode: n_steps, contiguous (ids are exactly 1..n), last_role."""
    return df.groupBy("episode_id").agg(
        F.count("*").alias("n_steps"),
        ((F.min("step") == 1) & (F.max("step") == F.count("*")) & (F.countDistinct("step") == F.count("*"))).alias("contiguous"),
        F.max_by("role", "step").alias("last_role"),
        F.max_by("action", "step").alias("last_action"),
    )


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule, in order, that holds; null if none does."""
    out = None
    for name, holds in rules:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def split_first(df: DataFrame, key: str, n: int, seed: object = 42, strata: list[str] | None = None) -> DataFrame:
    """Adds split: the n keys of least hash (in each stratum) are test, all others train; rows follow their key."""
    keys = df.select(key, *(strata or [])).distinct().withColumn("_h", seeded(key, seed=seed))
    if strata:
        w = Window.partitionBy(*strata).orderBy("_h", key)
        test = keys.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    else:
        test = keys.orderBy("_h", key).limit(n)
    on = [key, *(strata or [])]
    return df.join(F.broadcast(test.select(*on).withColumn("_test", F.lit(True))), on, "left").withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def evenly_spaced(items: str, k: int) -> Column:
    """At most k items of an array: all if there are no more, else the first, evenly spaced ones and the last."""
    n = F.size(items)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(items, F.when(i == k - 1, n).otherwise(F.floor(i * (n - 1) / (k - 1)).cast("int") + 1)))
    return F.when(n <= k, F.col(items)).otherwise(picks)


def first_and_last(items: str, k: int) -> Column:
    """The first item and the last k, without repeats, in order."""
    n = F.size(items)
    return F.array_distinct(F.concat(F.slice(items, 1, 1), F.slice(items, F.greatest(n - k + 1, F.lit(1)), k)))


def mark_repeats(df: DataFrame, same: Column) -> DataFrame:
    """is_use becomes false where a step repeats the one before; first and last steps and short episodes are left alone."""
    w = Window.partitionBy("episode_id").orderBy("step")
    size = F.count("*").over(Window.partitionBy("episode_id"))
    inner = (F.row_number().over(w) > 1) & (F.row_number().over(w) < size) & (size > 2)
    return df.withColumn("is_use", F.when(inner & F.coalesce(same, F.lit(False)), False).otherwise(F.col("is_use")))


def without_trailing(df: DataFrame, role: str = "assistant") -> DataFrame:
    """Steps up to the episode's last one of another role."""
    last = F.max(F.when(F.col("role") != role, F.col("step"))).over(Window.partitionBy("episode_id"))
    return df.withColumn("_last", last).where(F.col("step") <= F.col("_last")).drop("_last")
