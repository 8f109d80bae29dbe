"""Queries of work by ranks and of rewards that are given at run time."""

import pandas as pd
from pyspark.sql import functions as F

from tracewright.functions import rewards
from tracewright.operators import dispatch
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X
from tracewright.streaming.place import shared_dir


def _running(rank, frames):
    total = 0.0
    for frame in frames:
        sums = frame.o_totalprice.astype(float).cumsum() + total
        total = float(sums.iloc[-1]) if len(sums) else total
        yield pd.DataFrame({"o_orderkey": frame.o_orderkey, "rank": rank, "running": sums.round(2)})


@query("WITH p AS (SELECT o_orderkey, o_totalprice::DOUBLE AS x, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), r AS (SELECT *, pos // ((n + (7 - n % 7) % 7) // 7) AS rank FROM p) SELECT pos, o_orderkey, rank::INT AS rank, round(sum(x) OVER (PARTITION BY rank ORDER BY pos), 2) AS running FROM r")
def dispatch_ranks(spark, d):
    """Running sums of seven ranks over equal runs of rows, padded and cut back."""
    o = X.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return dispatch.dispatched(o, "o_orderkey", 7, _running, "o_orderkey long, rank int, running double")


@query("SELECT r_name, round(sum(CASE WHEN (n_nationkey + k) % 3 = 0 THEN n_nationkey * (k + 1.0) ELSE 0 END), 4)::DOUBLE AS total, 0 AS first FROM nation JOIN region ON n_regionkey = r_regionkey, range(4) x(k) GROUP BY 1")
def dispatch_all(spark, d):
    """Every nation at each of four ranks; what ranks made of it is summed."""
    n = X.read(spark, d, "nation").join(X.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = dispatch.to_all(n, 4).withColumn("total", F.when((F.col("n_nationkey") + F.col("rank")) % 3 == 0, F.col("n_nationkey") * (F.col("rank") + 1.0)).otherwise(0.0)).withColumn("first", F.col("rank"))
    return dispatch.reduced(each, ["r_name"], {"total": "sum", "first": "first"}).withColumn("total", F.round("total", 4))


SOURCE = '''
async def overlap(text, truth, *, weight, least=0.0):
    """The share of the truth's words that the text has."""
    words = set((truth or "").split())
    return {"score": max(least, weight * len(words & set((text or "").split())) / len(words)) if words else least}
'''


@query("WITH p AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS a, list_distinct(regexp_extract_all(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^\\x20\\x09-\\x0D]+')) AS b FROM conversations) SELECT conv_id, turn, round(CASE WHEN len(b) > 0 THEN greatest(0.05, 0.5 * len(list_intersect(a, b)) / len(b)) ELSE 0.05 END, 6)::DOUBLE AS score FROM p")
def score_custom(spark, d):
    """A reward from a file that is written just now: each turn against the turn before."""
    from pyspark.sql import Window

    root = shared_dir(spark)
    spark.createDataFrame([(SOURCE,)], "value string").coalesce(1).write.text(root)
    score = rewards.custom_reward(spark, root, "overlap", together=8, weight=0.5, least=0.05)
    c = X.read(spark, d, "conversations")
    c = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.round(score("text", "before"), 6).alias("score"))
