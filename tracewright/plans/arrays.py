"""Queries of token-level arithmetic: scans, masks, divergences, losses, importance weights, packing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import packing as P
from tracewright.operators import tokenwise as K
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X

T = "WITH " + X.TOKENS
PAIRS = "WITH " + X.TOKEN_PAIRS


def tokens(spark, d):
    return X.tokens(spark, d)


def pairs(spark, d):
    return X.token_pairs(spark, d)


def out(df, **columns):
    return df.select("id", *[F.round(c, 5).alias(n) for n, c in columns.items()])


@query(f"{T}, a AS (SELECT id, sum(x * m) AS s, sum(m) AS n, sum(x * x * m) AS q FROM tokens GROUP BY 1) SELECT id, round(s, 5) AS total, round(s / (n + 1e-8), 5) AS mean, round((q - s * s / n) / (n - 1), 5) AS variance FROM a")
def agg_masked(spark, d):
    return out(tokens(spark, d), total=K.masked_sum("x", "m"), mean=K.masked_mean("x", "m"), variance=K.masked_var("x", "m"))


@query(f"{T}, a AS (SELECT sum(m) AS n, sum(x * m) / sum(m) AS mean, sum(x * x * m) AS q FROM tokens), w AS (SELECT id, t, (x - mean) / sqrt((q - n * mean * mean) / (n - 1) + 1e-8) * m AS w FROM tokens, a) SELECT id, round(sum(w), 4) AS total FROM w GROUP BY 1")
def masked_whiten(spark, d):
    """Whitening over all unmasked tokens of the batch: three sums, combined before the shuffle, then arithmetic in the row."""
    t = tokens(spark, d)
    sums = t.agg(F.sum(K.add("m")).alias("n"), F.sum(K.masked_sum("x", "m")).alias("s"), F.sum(K.masked_sum(F.transform("x", lambda v: v * v), F.col("m"))).alias("q"))
    sums = sums.select((F.col("s") / F.col("n")).alias("mean"), F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) + 1e-8).alias("sd"))
    t = t.crossJoin(F.broadcast(sums))
    w = F.transform("x", lambda v: (v - F.col("mean")) / F.col("sd"))
    return t.select("id", F.round(K.masked_sum(w, F.col("m")), 4).alias("total"))


@query(f"{T}, s AS (SELECT id, uid, sum(x * m) AS s, sum(m) AS n FROM tokens GROUP BY 1, 2) SELECT uid, round(sum(s) / sum(n), 6) AS token_mean, round(avg(s), 6) AS seq_mean_token_sum, round(avg(s) / 64, 6) AS seq_mean_token_sum_norm, round(avg(s / n), 6) AS seq_mean_token_mean FROM s GROUP BY 1")
def agg_loss(spark, d):
    s = tokens(spark, d).select("uid", K.masked_sum("x", "m").alias("s"), K.add("m").alias("n"))
    mean = F.avg("s")
    return s.groupBy("uid").agg(
        F.round(F.sum("s") / F.sum("n"), 6).alias("token_mean"), F.round(mean, 6).alias("seq_mean_token_sum"), F.round(mean / 64, 6).alias("seq_mean_token_sum_norm"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("seq_mean_token_mean")
    )


@query(f"{T}, c AS (SELECT id, t, sum(x) OVER (PARTITION BY id ORDER BY t DESC) AS r FROM tokens) SELECT id, round(sum(r * (t + 1)), 4) AS weighted FROM c GROUP BY 1")
def win_reverse_cumsum(spark, d):
    r = K.reverse_cumsum(F.col("x"))
    return tokens(spark, d).select("id", F.round(K.add(F.transform(r, lambda v, i: v * (i + 1))), 4).alias("weighted"))


@query(f"{T}, p AS (SELECT a.id, a.t, sum(pow(0.9, b.t - a.t) * b.x) AS g FROM tokens a JOIN tokens b ON a.id = b.id AND b.t >= a.t AND b.m = 1 WHERE a.m = 1 GROUP BY 1, 2) SELECT id, round(sum(g), 4) AS total, round(arg_min(g, t), 5) AS first FROM p GROUP BY 1")
def win_discounted(spark, d):
    """Discounted returns; the mask's end resets the scan, so only unmasked tokens count."""
    g = tokens(spark, d).withColumn("g", K.discounted("x", "m", 0.9))
    return g.select("id", F.round(K.masked_sum("g", "m"), 4).alias("total"), F.round(F.col("g")[0], 5).alias("first"))


@query(f"{T}, v AS (SELECT id, t, m, x + 0.5 * CASE WHEN t < 63 THEN coalesce(lead(x * m) OVER (PARTITION BY id ORDER BY t), 0) * 0.99 ELSE 0 END - 0.5 * x AS delta FROM tokens), p AS (SELECT a.id, a.t, sum(pow(0.99 * 0.95, b.t - a.t) * b.delta) AS g FROM v a JOIN v b ON a.id = b.id AND b.t >= a.t AND b.m = 1 WHERE a.m = 1 GROUP BY 1, 2) SELECT id, round(sum(g), 4) AS total FROM p GROUP BY 1")
def adv_gae(spark, d):
    """Generalised advantages with values of half the reward."""
    g = tokens(spark, d).withColumn("v", F.transform("x", lambda x: x * 0.5)).withColumn("g", K.gae(F.col("x"), F.col("v"), F.col("m"), 0.99, 0.95))
    return g.select("id", F.round(K.masked_sum("g", "m"), 4).alias("total"))


@query(f"{T} SELECT id, round(sum(r * m) - 0.25 * sum(m), 4) AS total FROM (SELECT *, sum(x * m) OVER (PARTITION BY id ORDER BY t DESC) AS r FROM tokens) GROUP BY 1")
def adv_remax(spark, d):
    t = tokens(spark, d).withColumn("r", K.reverse_cumsum(K.masked("x", "m")))
    return t.select("id", F.round(K.masked_sum(F.transform("r", lambda v: v - 0.25), F.col("m")), 4).alias("total"))


@query(f"{T}, f AS (SELECT id, min(t) FILTER (WHERE x > 0.2) AS bad, min(t) FILTER (WHERE x < -0.15) AS mark FROM tokens GROUP BY 1) SELECT id, coalesce(bad, 64)::INT AS kept, CASE WHEN mark IS NULL THEN 64 ELSE 63 - mark END::INT AS after FROM f")
def win_after_marker(spark, d):
    """Tokens before the first invalid one, and tokens after the first marker (all without one)."""
    t = tokens(spark, d)
    marks = F.transform("x", lambda v: F.when(v < -0.15, 1).otherwise(0))
    kept, after = K.after_first("x", lambda v: v > 0.2), K.last_after_marker(marks, F.lit(1))
    return t.select("id", K.add(kept).cast("int").alias("kept"), K.add(after).cast("int").alias("after"))


CL = "greatest(-20, least(20, b - a))"


@query(f"{PAIRS} SELECT id, round(sum((a - b) * m) / greatest(sum(m), 1), 5) AS k1, round(sum(abs(a - b) * m) / greatest(sum(m), 1), 5) AS k_abs, round(sum((a - b) * (a - b) / 2 * m) / greatest(sum(m), 1), 5) AS k2, round(sum(greatest(-10, least(10, exp({CL}) - {CL} - 1)) * m) / greatest(sum(m), 1), 5) AS k3 FROM pairs GROUP BY 1")
def fn_kl(spark, d):
    p = pairs(spark, d)
    n = F.greatest(K.add("m"), F.lit(1.0))
    mean = lambda kind: K.masked_sum(F.zip_with("a", "b", lambda a, b: K.kl(a, b, kind)), F.col("m")) / n
    return out(p, k1=mean("k1"), k_abs=mean("abs"), k2=mean("k2"), k3=mean("k3"))


@query(f"{PAIRS}, s AS (SELECT id, sum((a - b) * m) / greatest(sum(m), 1) AS kl, sum(m) AS n, max(advantage) AS r FROM pairs GROUP BY 1) SELECT round(avg(kl), 6) AS kl, count(*) FILTER (WHERE n >= 48) AS truncated, round(avg(r), 6) AS reward FROM s")
def opd_kl_stats(spark, d):
    p = pairs(spark, d)
    kl = K.masked_sum(F.zip_with("a", "b", lambda a, b: a - b), F.col("m")) / F.greatest(K.add("m"), F.lit(1.0))
    s = p.select(kl.alias("kl"), K.add("m").alias("n"), "advantage")
    return s.agg(F.round(F.avg("kl"), 6).alias("kl"), F.count_if(F.col("n") >= 48).alias("truncated"), F.round(F.avg("advantage"), 6).alias("reward"))


@query(f"{PAIRS} SELECT id, round(sum((CASE WHEN t = 0 THEN advantage ELSE 0 END - 0.1 * (a - b)) * m), 5) AS reward, round(sum((advantage * CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END - 0.1 * (a - b) * CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END) * m), 5) AS advantage FROM pairs GROUP BY 1")
def kl_penalty(spark, d):
    """Rewards less a share of the divergence; advantages with both group masks."""
    p = pairs(spark, d)
    kl = F.zip_with("a", "b", lambda a, b: (a - b) * 0.1)
    zero, strong = F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0), F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0)
    reward = F.transform(kl, lambda v, i: F.when(i == 0, F.col("advantage")).otherwise(0.0) - v)
    advantage = F.transform(kl, lambda v: F.col("advantage") * zero - v * strong)
    return out(p, reward=K.masked_sum(reward, F.col("m")), advantage=K.masked_sum(advantage, F.col("m")))


@query(f"WITH RECURSIVE {X.ROLLOUTS}, d AS (SELECT data_source, avg(score) AS kl FROM rollouts GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY data_source) AS i FROM d), f AS (SELECT 0::BIGINT AS i, 0.1::DOUBLE AS beta UNION ALL SELECT o.i, f.beta * (1 + greatest(-0.2, least(0.2, o.kl / 0.5 - 1)) * 256 / 10000.0) FROM f JOIN o ON o.i = f.i + 1) SELECT round(arg_max(beta, i), 9) AS beta FROM f")
def kl_controller(spark, d):
    """The adaptive coefficient after the steps in order: a fold over one row a step."""
    s = X.rollouts(spark, d).groupBy("data_source").agg(F.avg("score").alias("kl"))
    l = s.agg(F.array_sort(F.collect_list(F.struct("data_source", "kl"))).alias("l"))
    beta = F.aggregate("l", F.lit(0.1), lambda b, x: b * (1 + K.clamped(x["kl"] / 0.5 - 1, -0.2, 0.2) * 256 / 10000.0))
    return l.select(F.round(beta, 9).alias("beta"))


RT = "exp(greatest(-20, least(20, a - b)))"


@query(f"{PAIRS}, l AS (SELECT id, m, CASE WHEN advantage < 0 THEN least(-advantage * 3, greatest(-advantage * {RT}, -advantage * greatest(0.8, least(1.2, {RT})))) ELSE greatest(-advantage * {RT}, -advantage * greatest(0.8, least(1.2, {RT}))) END AS loss, ({RT} < 0.8 OR {RT} > 1.2)::INT AS clipped FROM pairs) SELECT id, round(sum(loss * m) / sum(m), 5) AS loss, round(sum(clipped * m) / sum(m), 5) AS clip_share FROM l GROUP BY 1")
def loss_vanilla(spark, d):
    p = pairs(spark, d).withColumn("r", F.zip_with("a", "b", K.ratio))
    loss = F.transform("r", lambda r: K.dual_clip(r, F.col("advantage"), 0.2, 0.2, 3.0))
    clipped = F.transform("r", lambda r: F.when((r < 0.8) | (r > 1.2), 1.0).otherwise(0.0))
    n = K.add("m")
    return out(p, loss=K.masked_sum(loss, F.col("m")) / n, clip_share=K.masked_sum(clipped, F.col("m")) / n)


@query(f"{PAIRS}, s AS (SELECT id, max(advantage) AS adv, exp(least(10, sum((a - b) * m) / greatest(sum(m), 1))) AS r, sum(m) AS n, sum(a * m) AS la, sum(greatest(-0.4, least(0.4, (a - b) * m))) AS g FROM pairs GROUP BY 1) SELECT id, round(greatest(-adv * r, -adv * greatest(0.9997, least(1.0004, r))) + 0.0, 5) AS gspo, round(-adv * la / n + 0.0, 5) AS gpg, round(-adv * exp(g / n) + 0.0, 5) AS geo_mean FROM s")
def loss_sequence(spark, d):
    """Forward values of losses with one ratio a sequence: its mean log-ratio (clipped), plain policy gradient, geometric mean of clipped ratios."""
    p = pairs(spark, d)
    n, adv = K.add("m"), F.col("advantage")
    diff = F.zip_with("a", "b", lambda a, b: a - b)
    r = F.exp(F.least(F.lit(10.0), K.masked_sum(diff, F.col("m")) / F.greatest(n, F.lit(1.0))))
    g = K.add(F.transform(K.masked(diff, F.col("m")), lambda v: K.clamped(v, -0.4, 0.4)))
    return out(p, gspo=F.greatest(-adv * r, -adv * K.clamped(r, 0.9997, 1.0004)) + 0.0, gpg=-adv * K.masked_sum("a", "m") / n + 0.0, geo_mean=-adv * F.exp(g / n) + 0.0)


@query(f"{PAIRS}, w AS (SELECT id, m, advantage, a, {RT} AS r FROM pairs) SELECT id, round(sum(-advantage * least(r, 1.28) * a * m) / sum(m), 5) AS cispo, round(sum(-advantage * 4 / (1 + exp(-(CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END) * (r - 1))) / (CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END) * m) / sum(m), 5) AS sapo, round(sum(-advantage * least(r, 2.0) * a * m) / sum(m), 5) AS reinforce FROM w GROUP BY 1")
def loss_token(spark, d):
    """Forward values of losses with a weight for each token: clipped importance, soft gate, truncated importance."""
    p = pairs(spark, d).withColumn("r", F.zip_with("a", "b", K.ratio))
    n, adv = K.add("m"), F.col("advantage")
    weighted = lambda top: F.zip_with("r", "a", lambda r, a: -adv * F.least(r, F.lit(top)) * a)
    tau = F.when(adv > 0, 1.0).otherwise(1.05)
    soft = F.transform("r", lambda r: -adv * 4 / (1 + F.exp(-tau * (r - 1))) / tau)
    mean = lambda c: K.masked_sum(c, F.col("m")) / n
    return out(p, cispo=mean(weighted(1.28)), sapo=mean(soft), reinforce=mean(weighted(2.0)))


@query(f"{PAIRS}, l AS (SELECT id, m, 0.5 * greatest(pow(a - advantage, 2), pow(greatest(b - 0.2, least(b + 0.2, a)) - advantage, 2)) AS v FROM pairs) SELECT id, round(sum(v * m) / sum(m), 5) AS loss FROM l GROUP BY 1")
def loss_value(spark, d):
    """The clipped value loss, values being kept within 0.2 of the old ones."""
    p = pairs(spark, d)
    square = lambda x: x * x
    each = F.zip_with("a", "b", lambda a, b: F.greatest(square(a - F.col("advantage")), square(F.greatest(b - 0.2, F.least(b + 0.2, a)) - F.col("advantage"))) / 2)
    return out(p, loss=K.masked_sum(each, F.col("m")) / K.add("m"))


@query(f"{PAIRS}, s AS (SELECT id, sum((a - b) * m) AS d, max(advantage) AS r, least(10, exp(sum((a - b) * m))) AS w, sum(a * m) / sum(m) AS la, sum(b * m) / sum(m) AS lb FROM pairs GROUP BY 1) SELECT round(avg(pow(d - 0.5 * r, 2)), 5) AS sppo, round(avg(w * pow(0.3 + la - 2 * r - lb, 2)), 5) AS flowrl FROM s")
def loss_batch(spark, d):
    """Losses that are means over sequences: squared log-ratio against scaled reward, and flow balance."""
    m = F.col("m")
    diff = K.masked_sum(F.zip_with("a", "b", lambda a, b: a - b), m)
    s = pairs(spark, d).select(diff.alias("d"), F.col("advantage").alias("r"), (K.masked_sum("a", "m") / K.add("m")).alias("la"), (K.masked_sum("b", "m") / K.add("m")).alias("lb"))
    sppo = F.pow(F.col("d") - F.col("r") * 0.5, F.lit(2))
    flow = F.least(F.lit(10.0), F.exp("d")) * F.pow(F.col("la") + 0.3 - F.col("r") * 2 - F.col("lb"), F.lit(2))
    return s.agg(F.round(F.avg(sppo), 5).alias("sppo"), F.round(F.avg(flow), 5).alias("flowrl"))


@query(f"{PAIRS}, e AS (SELECT id, t, m, advantage, a, a - avg(a) OVER () AS ca, advantage - avg(advantage) OVER () AS cv FROM pairs WHERE m = 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ca * cv DESC, t) AS rn, count(*) OVER (PARTITION BY id) AS n FROM e) SELECT id, count(*) FILTER (WHERE rn <= ceil(n * 0.1)) AS chosen, round(sum(ca * cv) FILTER (WHERE rn <= ceil(n * 0.1)), 4) AS covariance FROM r GROUP BY 1")
def loss_kl_cov(spark, d):
    """The tenth of each sequence's tokens whose log-probability varies most with the advantage."""
    p = pairs(spark, d)
    n = F.sum(K.add("m"))
    means = p.agg((F.sum(K.masked_sum("a", "m")) / n).alias("ma"), (F.sum(F.col("advantage") * K.add("m")) / n).alias("mv"))
    p = p.crossJoin(F.broadcast(means))
    cov = F.zip_with("a", "m", lambda a, m: F.when(m > 0, (a - F.col("ma")) * (F.col("advantage") - F.col("mv"))))
    top = F.slice(F.sort_array(F.filter(cov, lambda v: v.isNotNull()), asc=False), 1, F.ceil(K.add("m") * 0.1).cast("int"))
    return p.select("id", F.size(top).cast("long").alias("chosen"), F.round(K.add(top), 4).alias("covariance"))


LR = "greatest(-20, least(20, a - b))"


@query(f"{PAIRS}, s AS (SELECT id, sum({LR} * m) AS total, sum(m) AS n, min(CASE WHEN m > 0 THEN {LR} END) AS low, sum(least(exp({LR}), 2.0) * m) AS w FROM pairs GROUP BY 1) SELECT id, round(w / n, 5) AS token_weight, round(least(exp(greatest(-20, least(20, total))), 2.0), 5) AS sequence_weight, exp(total / n) BETWEEN 1 / 1.05 AND 1.05 AS kept, low < ln(0.5) AS veto FROM s")
def is_weights(spark, d):
    """Truncated importance weights by token and sequence, rejection by geometric mean, and the veto on any token."""
    p = pairs(spark, d).withColumn("l", F.zip_with("a", "b", lambda a, b: K.clamped(a - b, -20.0, 20.0)))
    n, total = K.add("m"), K.masked_sum("l", "m")
    veto = F.exists(F.zip_with("l", "m", lambda v, m: (m > 0) & (v < F.log(F.lit(0.5)))), lambda v: v)
    weight = K.masked_sum(F.transform("l", lambda v: F.least(F.exp(v), F.lit(2.0))), F.col("m")) / n
    return p.select("id", F.round(weight, 5).alias("token_weight"), F.round(F.least(F.exp(K.clamped(total, -20.0, 20.0)), F.lit(2.0)), 5).alias("sequence_weight"), F.exp(total / n).between(1 / 1.05, 1.05).alias("kept"), veto.alias("veto"))


@query(f"{PAIRS}, w AS (SELECT least(exp({LR}), 2.0) AS w, {LR} AS l FROM pairs WHERE m = 1) SELECT round(avg(w), 6) AS mean, round(max(w), 6) AS highest, round(min(w), 6) AS lowest, round(stddev_pop(w), 6) AS deviation, round(1 / avg(pow(w / (SELECT avg(w) FROM w), 2)), 6) AS ess, round(avg((exp(l) > 2.0)::INT), 6) AS share_high, round(avg((exp(l) < 0.5)::INT), 6) AS share_low FROM w")
def is_metrics(spark, d):
    p = pairs(spark, d).select(F.explode(F.filter(F.zip_with(F.zip_with("a", "b", lambda a, b: K.clamped(a - b, -20.0, 20.0)), "m", lambda l, m: F.when(m > 0, l)), lambda v: v.isNotNull())).alias("l"))
    w = F.least(F.exp("l"), F.lit(2.0))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return p.agg(
        F.round(F.avg(w), 6).alias("mean"), F.round(F.max(w), 6).alias("highest"), F.round(F.min(w), 6).alias("lowest"), F.round(F.stddev_pop(w), 6).alias("deviation"),
        F.round(F.pow(F.avg(w), F.lit(2)) / F.avg(w * w), 6).alias("ess"), share(F.exp("l") > 2.0).alias("share_high"), share(F.exp("l") < 0.5).alias("share_low"),
    )


@query(f"{PAIRS}, s AS (SELECT id, sum(a * m) / sum(m) AS la, sum(b * m) / sum(m) AS lb, sum((exp({CL}) - {CL} - 1) * m) / sum(m) AS k3, sum((a - b) * m) AS total FROM pairs GROUP BY 1) SELECT round(avg(exp(-la)), 5) AS ppl, round(avg(exp(-lb)), 5) AS rollout_ppl, round(avg(lb - la), 6) AS log_ppl_diff, round(avg(k3), 6) AS k3, round(avg(exp(2 * greatest(-2, least(2, total))) - 1), 4) AS chi2 FROM s")
def offpolicy_metrics(spark, d):
    p, n = pairs(spark, d), K.add("m")
    mean = lambda c: K.masked_sum(c, F.col("m")) / n
    s = p.select(mean("a").alias("la"), mean("b").alias("lb"), mean(F.zip_with("a", "b", lambda a, b: F.exp(K.clamped(b - a, -20.0, 20.0)) - K.clamped(b - a, -20.0, 20.0) - 1)).alias("k3"), K.masked_sum(F.zip_with("a", "b", lambda a, b: a - b), F.col("m")).alias("total"))
    return s.agg(
        F.round(F.avg(F.exp(-F.col("la"))), 5).alias("ppl"), F.round(F.avg(F.exp(-F.col("lb"))), 5).alias("rollout_ppl"), F.round(F.avg(F.col("lb") - F.col("la")), 6).alias("log_ppl_diff"),
        F.round(F.avg("k3"), 6).alias("k3"), F.round(F.avg(F.exp(K.clamped(F.col("total"), -2.0, 2.0) * 2) - 1), 4).alias("chi2"),
    )


@query(f"""{PAIRS}, z AS (SELECT id, ln(sum(exp(a))) AS za, ln(sum(exp(b))) AS zb FROM pairs GROUP BY 1), q AS (SELECT p.id, t, a - za AS la, b - zb AS lb, row_number() OVER (PARTITION BY p.id ORDER BY a DESC, t) AS k FROM pairs p JOIN z USING (id)),
s AS (SELECT id, la, lb FROM q WHERE k <= 8 UNION ALL SELECT id, ln(1 - least(sum(exp(la)), exp(-1e-7))), ln(1 - least(sum(exp(lb)), exp(-1e-7))) FROM q WHERE k <= 8 GROUP BY 1),
e AS (SELECT id, -sum(exp(la) * la) AS entropy FROM q GROUP BY 1)
SELECT s.id, round(sum(exp(la) * (la - lb)), 5) AS forward, round(sum(exp(lb) * (lb - la)), 5) AS backward, round(0.5 * sum(exp(la) * (la - ln(0.5 * exp(la) + 0.5 * exp(lb)))) + 0.5 * sum(exp(lb) * (lb - ln(0.5 * exp(la) + 0.5 * exp(lb)))), 5) AS jensen, round(max(entropy), 5) AS entropy FROM s JOIN e USING (id) GROUP BY 1""")
def topk_divergence(spark, d):
    """Divergences over the eight entries that the first of two distributions holds most likely and the tail of all others, and its entropy over all."""
    p = pairs(spark, d).select("id", K.log_softmax("a").alias("la"), K.log_softmax("b").alias("lb"))
    p = p.withColumn("top", K.most_likely("la", 8))
    p = p.select("id", "la", K.with_tail(F.col("la"), F.col("top")).alias("ta"), K.with_tail(F.col("lb"), F.col("top")).alias("tb"))
    of = lambda alpha: K.divergence("ta", "tb", alpha)
    return out(p, forward=of(0.0), backward=of(1.0), jensen=of(0.5), entropy=-K.add(F.transform("la", lambda u: F.exp(u) * u)))


@query(f"WITH RECURSIVE {X.ROLLOUTS}, o AS (SELECT floor(row_id / 64)::BIGINT AS block, data_source, length, row_number() OVER (PARTITION BY floor(row_id / 64), data_source ORDER BY row_id) AS i FROM rollouts), f AS (SELECT block, data_source, 0::BIGINT AS i, [0, 0, 0, 0]::INT[] AS bins FROM (SELECT DISTINCT block, data_source FROM o) UNION ALL SELECT o.block, o.data_source, o.i, list_transform(f.bins, lambda b, k: CASE WHEN k = list_position(f.bins, list_min(f.bins)) THEN b + o.length ELSE b END) FROM f JOIN o ON o.block = f.block AND o.data_source = f.data_source AND o.i = f.i + 1) SELECT block, data_source, array_to_string(arg_max(bins, i), ',') AS bins FROM f GROUP BY 1, 2")
def pack_greedy(spark, d):
    """Rows in order go to the least loaded of four bins: a fold over the lengths of each source's blocks of 64 ids."""
    r = X.rollouts(spark, d).withColumn("block", F.floor(F.col("row_id") / 64))
    return P.greedy_loads(r, ["block", "data_source"], "length", "row_id", 4).select("block", "data_source", F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"))


@query()
def pack_karmarkar_karp(spark, d):
    """Each source's first rows in blocks of 64, parted in four by largest differencing."""
    r = X.rollouts(spark, d).withColumn("block", F.floor(F.col("row_id") / 64))
    return P.karmarkar_karp(r, "block", "length", "row_id", 4)


@query()
def balance_batch(spark, d):
    """Blocks parted by workload into equal sizes, each part's rows in interleaved order, with what imbalance is left."""
    r = X.rollouts(spark, d).withColumn("block", F.floor(F.col("row_id") / 64)).withColumn("work", F.col("length") * 24576 + F.col("length") * F.col("length"))
    p = P.karmarkar_karp(r, "block", "work", "row_id", 4, equal=True)
    w = Window.partitionBy("block", "bin").orderBy("weight", "row_id")
    p = p.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("block", "bin")))
    return p.select("block", "row_id", "bin", F.when(F.col("i") % 2 == 0, F.floor(F.col("i") / 2)).otherwise(F.col("n") - 1 - F.floor(F.col("i") / 2)).alias("place"))


@query(f"WITH {X.ROLLOUTS}, b AS (SELECT floor(row_id / 64)::BIGINT AS block, count(*) AS n, ceil(sum(length) / 1000.0) AS c FROM rollouts GROUP BY 1) SELECT block, (ceil(least(n, c) / 2) * 2)::BIGINT AS micro FROM b")
def micro_batches(spark, d):
    """How many micro-batches a block needs for 1000 tokens each, in multiples of two."""
    r = X.rollouts(spark, d).groupBy(F.floor(F.col("row_id") / 64).alias("block")).agg(F.count("*").alias("n"), F.ceil(F.sum("length") / 1000).alias("c"))
    return r.select("block", (F.ceil(F.least("n", "c") / 2) * 2).cast("long").alias("micro"))


@query(f"WITH {X.ROLLOUTS} SELECT row_id, length FROM rollouts")
def restore_order(spark, d):
    """Rows reordered by length and put back by their stored position."""
    r = X.rollouts(spark, d).select("row_id", "length")
    moved = r.withColumn("place", F.md5(F.concat_ws(":", "length", "row_id")))
    return moved.select("place", "length").join(moved.select("place", "row_id"), "place").select("row_id", "length")
