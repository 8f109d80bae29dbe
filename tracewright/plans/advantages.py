"""Queries of group analytics: estimators, group filters, masks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import advantage as A
from tracewright.operators.order import numbered, running
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X

# Rows with an own group (every 501st) besides the users' groups.
R = "WITH " + X.ROLLOUTS + ", g AS (SELECT * REPLACE (CASE WHEN row_id % 501 = 0 THEN -row_id - 1 ELSE uid END AS uid) FROM rollouts)"
STATS = R + ", s AS (SELECT *, count(*) OVER w AS n, CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS mean, CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END AS sd, var_samp(score) OVER w AS v FROM g WINDOW w AS (PARTITION BY uid))"


def rows(spark, d):
    r = X.rollouts(spark, d)
    return r.withColumn("uid", F.when(F.col("row_id") % 501 == 0, -F.col("row_id") - 1).otherwise(F.col("uid")))


def newest(df, by, n):
    """The n rows of greatest row_id of each key, with their place from 1; each task keeps n of a key before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("row_id")))).where(F.col("place") <= n)


def shown(df, digits=9):
    return df.select("row_id", F.round("advantage", digits).alias("advantage"))


@query(f"{STATS} SELECT row_id, round((score - mean) / (sd + 1e-6), 9) AS advantage FROM s")
def adv_grpo(spark, d):
    return shown(A.grpo(rows(spark, d)))


@query(f"{STATS} SELECT row_id, round(score - mean, 9) AS advantage FROM s")
def adv_grpo_unscaled(spark, d):
    return shown(A.grpo(rows(spark, d), normalize=False))


@query(f"{STATS} SELECT row_id, round((score - mean) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(v, 1e-6)) END + 1e-6), 9) AS advantage FROM s")
def adv_grpo_vectorized(spark, d):
    return shown(A.grpo_floored(rows(spark, d)))


@query(f"{STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS rn, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS next FROM s) SELECT row_id, round(CASE WHEN rn = 1 THEN (score - next) / (sqrt(v) + 1e-6) WHEN n > 1 THEN 0 END, 9) AS advantage FROM r")
def adv_grpo_passk(spark, d):
    return shown(A.grpo_passk(rows(spark, d)))


RLOO = STATS + ", r AS (SELECT *, avg(score) OVER (PARTITION BY uid) AS m FROM s) SELECT row_id, round(CASE WHEN n > 1 THEN (score - m) * n / (n - 1) ELSE {0} END, 9) AS advantage FROM r"


@query(RLOO.format("score"))
def adv_rloo(spark, d):
    return shown(A.rloo(rows(spark, d)))


@query(RLOO.format("0"))
def adv_rloo_vectorized(spark, d):
    return shown(A.rloo(rows(spark, d), single="zero"))


@query(f"{R} SELECT row_id, round(score - sum(score * length) OVER (PARTITION BY uid) / sum(length) OVER (PARTITION BY uid), 9) AS advantage FROM g")
def adv_opo(spark, d):
    return shown(A.opo(rows(spark, d)))


@query(f"{STATS}, t AS (SELECT count(*) AS b, greatest(count(*) FILTER (WHERE acc <> 0), 1) AS nz FROM g), q AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE avg(acc) OVER (PARTITION BY uid) END AS am FROM s) SELECT row_id, round(b / nz * (acc - am), 9) AS advantage FROM q, t")
def adv_gpg(spark, d):
    return shown(A.gpg(rows(spark, d), score="acc"))


@query(f"{STATS}, c AS (SELECT *, score - mean AS a FROM s), t AS (SELECT sum(a * length) / sum(length) AS am, sum(length) AS kk, sum(a * a * length) AS q FROM c) SELECT row_id, round((a - am) / sqrt((q - kk * am * am) / (kk - 1) + 1e-8), 5) AS advantage FROM c, t")
def adv_rf_pp_baseline(spark, d):
    """Centred scores on every token of a row, whitened over the batch: each row counts by its length."""
    c = A.with_stats(rows(spark, d)).withColumn("a", F.col("score") - F.col("mean"))
    k, s, q = F.sum("length"), F.sum(F.col("a") * F.col("length")), F.sum(F.col("a") * F.col("a") * F.col("length"))
    t = c.agg((s / k).alias("m"), F.sqrt((q - s * s / k) / (k - 1) + 1e-8).alias("sd"))
    return c.crossJoin(F.broadcast(t)).select("row_id", F.round((F.col("a") - F.col("m")) / F.col("sd"), 5).alias("advantage"))


@query(f"{R} SELECT row_id, uid FROM (SELECT *, avg(acc) OVER (PARTITION BY uid) AS m, count(*) OVER (PARTITION BY uid) AS n FROM g) WHERE (m > 0.4 AND m < 0.55) OR n = 1")
def flt_groups_dapo(spark, d):
    return A.kept_groups(rows(spark, d), low=0.4, high=0.55).select("row_id", "uid")


@query(f"{R} SELECT uid, round(avg(acc), 6) AS mean, CASE WHEN avg(acc) > 0.5 THEN 0.0 ELSE 1.0 END::DOUBLE AS kl_loss_mask, CASE WHEN avg(acc) < 0.01 THEN 0.0 ELSE 1.0 END::DOUBLE AS passrate_0_mask FROM g GROUP BY 1")
def kl_masks(spark, d):
    m = rows(spark, d).groupBy("uid").agg(F.avg("acc").alias("mean"))
    kl, zero = A.kl_masks(F.col("mean"), 0.5)
    return m.select("uid", F.round("mean", 6).alias("mean"), kl.alias("kl_loss_mask"), zero.alias("passrate_0_mask"))


@query(f"{R}, p AS (SELECT uid, min(row_id) AS first FROM g WHERE acc = 1 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY first) AS k FROM p) SELECT uid, floor((k - 1) / 32)::BIGINT AS batch FROM o WHERE k <= floor((SELECT count(*) FROM o) / 32) * 32")
def accumulate_batches(spark, d):
    """Prompts in order of arrival fill batches of 32; an unfinished batch waits."""
    p = rows(spark, d).where("acc = 1").groupBy("uid").agg(F.min("row_id").alias("first"))
    whole = p.count() // 32 * 32
    return numbered(p, "first").where(F.col("pos") < whole).select("uid", F.floor(F.col("pos") / 32).alias("batch"))


@query(f"{R}, b AS (SELECT uid, avg(acc) AS m, max(length) AS longest, min(row_id) AS first, count(*) AS n FROM g GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY NOT (m BETWEEN 0.2 AND 0.6 AND longest < 99), first) AS k FROM b) SELECT uid, m BETWEEN 0.2 AND 0.6 AND longest < 99 AS passed FROM o WHERE k <= (SELECT count(*) FROM o) // 4")
def flt_oversample_prime(spark, d):
    """Groups that pass come first; the first quarter stays, by positions: neither a sorted partition nor a quarter of all in one task."""
    b = rows(spark, d).groupBy("uid").agg(F.avg("acc").alias("m"), F.max("length").alias("longest"), F.min("row_id").alias("first"))
    b = b.withColumn("passed", F.col("m").between(0.2, 0.6) & (F.col("longest") < 99))
    low, high, n = b.agg(F.min("first"), F.max("first"), F.count("*")).first()
    b = b.withColumn("key", F.when(F.col("passed"), F.col("first")).otherwise(F.col("first") + F.lit((high or 0) - (low or 0) + 1)))
    return numbered(b, "key").where(F.col("pos") < n // 4).select("uid", "passed")


@query(f"{R}, t AS (SELECT *, floor(row_id / 8)::BIGINT AS block FROM rollouts) SELECT row_id, round(score - (sum(score) OVER (PARTITION BY block) - score) / greatest(count(*) OVER (PARTITION BY block) - 1, 1), 6) AS advantage FROM t")
def adv_prime_rloo(spark, d):
    """Leave-one-out over consecutive blocks of eight rows."""
    t = X.rollouts(spark, d).withColumn("block", F.floor(F.col("row_id") / 8))
    s = t.groupBy("block").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    return t.join(s, "block").select("row_id", F.round(F.col("score") - (F.col("s") - F.col("score")) / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("advantage"))


@query(f"{R}, o AS (SELECT uid, acc, row_number() OVER (PARTITION BY uid ORDER BY row_id DESC) AS k FROM g) SELECT uid, round(avg(acc) FILTER (WHERE k <= 3), 6) AS rate, count(*) >= 2 AND avg(acc) FILTER (WHERE k <= 3) > 46.9999 / 48 AS solved FROM o GROUP BY 1")
def win_last3_passrate(spark, d):
    """A prompt's mean over its last three observations; solved ones leave the sampler."""
    last = newest(rows(spark, d), "uid", 3).groupBy("uid").agg(F.count("*").alias("n"), F.avg("acc").alias("rate"))
    return last.select("uid", F.round("rate", 6).alias("rate"), ((F.col("n") >= 2) & (F.col("rate") > 46.9999 / 48)).alias("solved"))


@query(f"{R}, o AS (SELECT uid, row_id, acc, sum(acc) OVER (PARTITION BY uid ORDER BY row_id) AS island FROM g), z AS (SELECT uid, row_id, row_number() OVER (PARTITION BY uid, island ORDER BY row_id) AS k, acc, island FROM o WHERE acc = 0) SELECT uid, count(*) FILTER (WHERE k % 3 = 0) AS fired FROM z GROUP BY 1")
def st_passrate0_counter(spark, d):
    """How often three zeros in a row came up, counting anew after each: gaps and islands, whose numbers are sums by ranges of ids."""
    o = running(rows(spark, d).select("uid", "row_id", "acc"), "uid", "acc", ["row_id"], {"_range": F.floor(F.col("row_id") / 65_536)}, to="island")
    runs = o.where("acc = 0").groupBy("uid", "island").agg(F.floor(F.count("*") / 3).alias("f"))
    return runs.groupBy("uid").agg(F.sum("f").alias("fired"))


@query(f"{R}, f AS (SELECT uid, k, min(row_id) AS first FROM g WHERE acc = 1 GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY first DESC) AS n FROM f) SELECT uid, string_agg(k::VARCHAR, ',' ORDER BY first) AS buffer FROM l WHERE n <= 5 GROUP BY 1")
def st_thought_buffer(spark, d):
    """The last five distinct entries of right answers, by first occurrence, for each prompt."""
    f = rows(spark, d).where("acc = 1").groupBy("uid", "k").agg(F.min("row_id").alias("row_id"))
    l = newest(f, "uid", 5).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("row_id", "k"))).alias("l"))
    return l.select("uid", F.array_join(F.transform("l", lambda v: v["k"].cast("string")), ",").alias("buffer"))


@query(f"{R}, q AS (SELECT data_source, row_id, row_number() OVER (PARTITION BY data_source ORDER BY row_id DESC) AS n FROM rollouts) SELECT data_source, count(*) AS produced, count(*) FILTER (WHERE n <= 100) AS held, count(*) FILTER (WHERE n > 100) AS dropped, min(row_id) FILTER (WHERE n <= 100) AS oldest FROM q GROUP BY 1")
def st_bounded_queue(spark, d):
    """A queue of the newest hundred of each source, and what it dropped."""
    r = X.rollouts(spark, d)
    made = r.groupBy(F.col("data_source").alias("source")).agg(F.count("*").alias("produced"))
    held = newest(r, "data_source", 100).groupBy("data_source").agg(F.count("*").alias("held"), F.min("row_id").alias("oldest"))
    held = held.join(made, F.col("data_source").eqNullSafe(F.col("source")))
    return held.select("data_source", "produced", "held", (F.col("produced") - F.col("held")).alias("dropped"), "oldest")


@query(f"{R} SELECT row_id FROM rollouts WHERE row_id NOT IN (SELECT row_id FROM rollouts WHERE length > 50)")
def st_resume(spark, d):
    r = X.rollouts(spark, d)
    return r.select("row_id").join(r.where("length > 50").select("row_id"), "row_id", "left_anti")


@query(f"{R}, o AS (SELECT uid, row_id, acc, lag(acc) OVER (PARTITION BY uid ORDER BY row_id) AS prev, sum(1 - acc) OVER (PARTITION BY uid ORDER BY row_id) AS fails, row_number() OVER (PARTITION BY uid ORDER BY row_id) AS n FROM g), e AS (SELECT uid, max(n) - coalesce(max(n) FILTER (WHERE acc = 0), 0) AS streak FROM o GROUP BY 1) SELECT uid, round(greatest(0.04, pow(0.5, streak)), 6) AS ratio FROM e")
def st_replay_ratio(spark, d):
    """Each prompt's chance of being sampled again: halved at every success in a row, 1 after a failure, 0.04 at least.

    Five successes in a row reach the least chance, so what came before the newest five rows has no effect.
    """
    o = newest(rows(spark, d), "uid", 5).groupBy("uid").agg(F.min(F.when(F.col("acc") == 0, F.col("place"))).alias("failed"), F.count("*").alias("n"))
    streak = F.coalesce(F.col("failed") - 1, F.col("n"))
    return o.select("uid", F.round(F.greatest(F.lit(0.04), F.pow(F.lit(0.5), streak)), 6).alias("ratio"))
