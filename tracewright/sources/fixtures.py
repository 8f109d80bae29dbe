"""The driver's tables in the shapes of trajectories, rollouts, token arrays and grounding samples; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory steps: episode_id, step (from 1), role, action, device, is_use and is_delete (both may be null)."""
    c = read(spark, sf_dir, "conversations")
    mark = F.md5(F.concat_ws(":", "conv_id", "turn"))
    a, b = F.substring(mark, 1, 1), F.substring(mark, 2, 1)
    return c.select(
        F.col("conv_id").alias("episode_id"),
        (F.col("turn") + 1).cast("int").alias("step"),
        "role",
        F.col("text").alias("action"),
        F.when(F.col("conv_id") % 2 == 0, "mobile").otherwise("desktop").alias("device"),
        F.when(a.isin("4", "5"), False).when(a > "5", True).alias("is_use"),
        F.when(b.isin("0", "1"), True).when(b > "5", False).alias("is_delete"),
    )


STEPS = """steps AS (
  SELECT conv_id AS episode_id, (turn + 1)::INT AS step, role, text AS action,
         CASE WHEN conv_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device,
         CASE WHEN substr(md5(conv_id || ':' || turn), 1, 1) IN ('4', '5') THEN false WHEN substr(md5(conv_id || ':' || turn), 1, 1) > '5' THEN true END AS is_use,
         CASE WHEN substr(md5(conv_id || ':' || turn), 2, 1) IN ('0', '1') THEN true WHEN substr(md5(conv_id || ':' || turn), 2, 1) > '5' THEN false END AS is_delete
  FROM conversations)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored responses: row_id, uid, data_source, score, acc, k, length, ts."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("uid"),
        F.col("event_type").alias("data_source"),
        (F.col("value") / 100).alias("score"),
        (F.col("value") > 50).cast("double").alias("acc"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_id") % 97 + 3).cast("int").alias("length"),
        "ts",
    )


ROLLOUTS = """rollouts AS (
  SELECT event_id AS row_id, user_id AS uid, event_type AS data_source, value / 100 AS score, (value > 50)::INT::DOUBLE AS acc,
         (props->>'$.k')::INT AS k, (event_id % 97 + 3)::INT AS length, ts
  FROM events)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays: id, uid, x (values), m (mask, 1 for the first 24 + 4 * uid tokens)."""
    e = read(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    m = F.transform("embedding", lambda v, i: F.when(i < 24 + 4 * F.col("label"), 1.0).otherwise(0.0))
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("uid"), x.alias("x"), m.alias("m"))


TOKENS = """tokens AS (
  SELECT vec_id AS id, label AS uid, generate_subscripts(embedding, 1) - 1 AS t, unnest(embedding)::DOUBLE AS x,
         CASE WHEN generate_subscripts(embedding, 1) - 1 < 24 + 4 * label THEN 1.0 ELSE 0.0 END::DOUBLE AS m
  FROM embeddings)"""


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two log-probabilities a token, of a sequence and the next one: id, uid, a, b, m, advantage."""
    t = tokens(spark, sf_dir)
    lp = lambda c: F.transform(c, lambda v: -F.abs(v) * 2)
    other = t.select((F.col("id") - 1).alias("id"), lp("x").alias("b"))
    return t.join(other, "id").select("id", "uid", lp("x").alias("a"), "b", "m", (F.col("id") % 5 - 2.0).alias("advantage"))


TOKEN_PAIRS = (
    TOKENS
    + """, pairs AS (
  SELECT p.id, p.uid, p.t, -abs(p.x) * 2 AS a, -abs(q.x) * 2 AS b, p.m, (p.id % 5 - 2.0)::DOUBLE AS advantage
  FROM tokens p JOIN tokens q ON q.id = p.id + 1 AND q.t = p.t)"""
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted points with target boxes: sample keys, group, ui_type, px, py, x1, y1, x2, y2."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("ui_type"),
        (F.col("l_quantity") * 20).alias("px"), (F.col("l_extendedprice") % 1000).alias("py"),
        (F.col("l_partkey") % 500).cast("double").alias("x1"), (F.col("l_suppkey") * 7 % 500).cast("double").alias("y1"),
        (F.col("l_partkey") % 500 + 400).cast("double").alias("x2"), (F.col("l_suppkey") * 7 % 500 + 450).cast("double").alias("y2"),
    )


BOXES = """boxes AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS grp, l_linestatus AS ui_type, l_quantity * 20 AS px, l_extendedprice % 1000 AS py,
         (l_partkey % 500)::DOUBLE AS x1, (l_suppkey * 7 % 500)::DOUBLE AS y1, (l_partkey % 500 + 400)::DOUBLE AS x2, (l_suppkey * 7 % 500 + 450)::DOUBLE AS y2
  FROM lineitem)"""
