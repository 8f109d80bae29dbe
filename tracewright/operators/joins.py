"""Join-shaped lookups with their defaults; Spark picks the physical join by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, other: DataFrame, on: str | list[str], **defaults: object) -> DataFrame:
    """Left join; where nothing matched, and where a value is null, the default stands."""
    out = df.join(other, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def by_prefix(df: DataFrame, names: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """``value`` of the row whose name equals the key, else of the only name that starts with it; else null.

    The prefix rule is an equi-join too: each name is listed under each of its prefixes, once, with how many names
    share it.
    """
    exact = names.select(F.col(name).alias(key), F.col(value).alias("_exact"))
    starts = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(name, F.lit(1), n))).alias(key), name, value)
    unique = starts.groupBy(key).agg(F.countDistinct(name).alias("_n"), F.min(value).alias("_prefix")).where("_n = 1").drop("_n")
    return df.join(exact, key, "left").join(unique, key, "left").withColumn(value, F.coalesce("_exact", "_prefix")).drop("_exact", "_prefix")


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float, parts: int = 16) -> DataFrame:
    """Points with the spans that hold them, both ends included: an equi-join on buckets of ``width`` that a span covers.

    A bucket's points are dealt to ``parts``, each of which meets the bucket's spans, and both sides are dealt by bucket
    and part to as many tasks as shuffles have: rows in are few for the pairs that come out, so neither files nor bytes
    tell how much work a task gets. A width of a fraction of a span makes few pairs that don't hold.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = points.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / width)).withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.lit(parts)).cast("int"))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    p, s = (x.repartition(tasks, "_bucket", "_part") for x in (p, s))
    return p.join(s, ["_bucket", "_part"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket", "_part")
