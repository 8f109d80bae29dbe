"""Queries of evaluation roll-ups and batch metrics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions.geometry import point_in_box
from tracewright.operators import metrics as M
from tracewright.operators.order import ranked
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X

R = "WITH " + X.ROLLOUTS
B = f"WITH {X.BOXES}, h AS (SELECT *, px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AS hit FROM boxes)"


def hits(spark, d):
    b = X.boxes(spark, d)
    return b.withColumn("hit", point_in_box(F.col("px"), F.col("py"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]))


@query(f"{B} SELECT coalesce(grp, 'all') AS grp, coalesce(ui_type, 'all') AS ui_type, count(*) AS n, count(*) FILTER (WHERE hit) AS correct, round(avg(hit::INT), 6) AS accuracy FROM h GROUP BY GROUPING SETS ((grp, ui_type), (grp), ())")
def agg_group_uitype(spark, d):
    return M.accuracy_by(hits(spark, d), "hit", "grp", "ui_type")


@query(f"{B} SELECT grp AS category, round(avg(hit::INT), 6) AS accuracy, (SELECT round(avg(hit::INT), 6) FROM h WHERE grp IN ('A', 'N')) AS overall FROM h GROUP BY 1")
def agg_category_acc(spark, d):
    h = hits(spark, d)
    known = h.where(F.col("grp").isin("A", "N")).agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("overall"))
    return h.groupBy(F.col("grp").alias("category")).agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("accuracy")).crossJoin(F.broadcast(known))


@query(f"{B}, e AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 3 = 0 END AS same, hit, ui_type = 'F' AS grounded FROM h) SELECT count(*) AS total, count(*) FILTER (WHERE same IS NULL) AS errors, count(same) AS valid, round(coalesce(count(*) FILTER (WHERE same) / nullif(count(same), 0)::DOUBLE, 0), 6) AS type_accuracy, round(coalesce(count(*) FILTER (WHERE same IS NOT NULL AND grounded AND hit) / nullif(count(*) FILTER (WHERE same IS NOT NULL AND grounded), 0)::DOUBLE, 0), 6) AS grounding_accuracy, round(coalesce(count(*) FILTER (WHERE same AND (NOT grounded OR hit)) / nullif(count(same), 0)::DOUBLE, 0), 6) AS overall FROM e")
def agg_eval_metrics(spark, d):
    h = hits(spark, d).select(F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") % 3 == 0).alias("same"), "hit", (F.col("ui_type") == "F").alias("grounded"))
    return M.action_metrics(h, "same", "grounded", "hit")


@query("SELECT lang AS suffix, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1")
def agg_suffix_dist(spark, d):
    return X.read(spark, d, "documents").groupBy(F.col("lang").alias("suffix")).agg(F.count("*").alias("n")).orderBy("suffix")


@query("SELECT coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, ''), lang, 'unknown') AS category, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def agg_value_counts_top(spark, d):
    docs = X.read(spark, d, "documents")
    category = F.coalesce(F.nullif(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")), F.lit("")), "lang", F.lit("unknown"))
    return docs.groupBy(category.alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query(f"{R}, p AS (SELECT data_source, uid, avg(score) AS m FROM rollouts GROUP BY 1, 2) SELECT data_source, round(avg(m), 6) AS mean FROM p GROUP BY 1")
def agg_source_mean(spark, d):
    p = X.rollouts(spark, d).groupBy("data_source", "uid").agg(F.avg("score").alias("m"))
    return p.groupBy("data_source").agg(F.round(F.avg("m"), 6).alias("mean"))


@query(f"{R} SELECT data_source, round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std FROM rollouts GROUP BY 1")
def agg_global_val(spark, d):
    return M.mean_and_deviation(X.rollouts(spark, d), ["data_source"], "acc", "score")


@query(f"{R}, u AS (SELECT data_source, uid, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM rollouts GROUP BY 1, 2) SELECT data_source, n, round(avg(m), 6) AS mean_at_n, round(avg(s), 6) AS std_at_n, count(*) AS uids FROM u GROUP BY 1, 2")
def agg_val_metrics(spark, d):
    u = X.rollouts(spark, d).groupBy("data_source", "uid").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count("*").alias("n"))
    return u.groupBy("data_source", "n").agg(F.round(F.avg("m"), 6).alias("mean_at_n"), F.round(F.avg("s"), 6).alias("std_at_n"), F.count("*").alias("uids"))


@query(f"{R}, o AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score, row_id) AS i, count(*) OVER (PARTITION BY uid) AS c FROM rollouts), n(k) AS (VALUES (2), (4), (8)) SELECT uid, k AS n, round(sum(score * (pow(i / c::DOUBLE, k) - pow((i - 1) / c::DOUBLE, k))), 6) AS best, round(sum(score * (pow((c - i + 1) / c::DOUBLE, k) - pow((c - i) / c::DOUBLE, k))), 6) AS worst FROM o, n GROUP BY 1, 2")
def boot_best_worst(spark, d):
    """Expected best and worst of n draws with replacement, from order statistics instead of resampling."""
    return M.best_and_worst_of(X.rollouts(spark, d), "uid", "score", [2, 4, 8])


@query(f"""{R}, o AS (SELECT uid, row_id, score, k % 5 AS pred, row_number() OVER (PARTITION BY uid ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY uid) AS c FROM rollouts),
 d AS (SELECT uid, b, j, ('0x' || substr(md5('7:' || uid || ':' || b || ':' || j), 1, 8))::BIGINT % c AS place FROM (SELECT DISTINCT uid, c FROM o), range(20) r(b), range(4) s(j)),
 m AS (SELECT d.uid, b, j, score, pred, count(*) OVER (PARTITION BY d.uid, b, pred) AS n FROM d JOIN o ON o.uid = d.uid AND o.place = d.place),
 v AS (SELECT uid, b, max(score) AS best, min(score) AS worst, avg(score) AS mean, arg_min(score, n * -100 + j) AS maj FROM m GROUP BY 1, 2)
 SELECT uid, round(avg(best), 6) AS best_mean, round(stddev_pop(best), 6) AS best_std, round(avg(worst), 6) AS worst_mean, round(stddev_pop(worst), 6) AS worst_std, round(avg(mean), 6) AS mean_mean, round(stddev_pop(mean), 6) AS mean_std,
 round(avg(maj), 6) AS maj_mean, round(stddev_pop(maj), 6) AS maj_std FROM v GROUP BY 1""")
def boot_reduce(spark, d):
    """Best, worst, mean and majority vote of four draws, over twenty replicates of each group."""
    reduce = {"best": M.highest("score"), "worst": M.lowest("score"), "mean": M.average("score"), "maj": M.voted("pred", "score")}
    r = X.rollouts(spark, d).withColumn("pred", F.col("k") % 5)
    out = M.bootstrapped(r, "uid", "row_id", ["score", "pred"], size=4, replicates=20, reduce=reduce, seed=7)
    return out.select("uid", *[F.round(c, 6).alias(c) for c in out.columns if c != "uid"])


@query(f"{R}, c AS (SELECT uid, k % 5 AS pred, count(*) AS n, min(row_id) AS first FROM rollouts GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS r FROM c) SELECT w.uid, w.pred, round(x.score, 6) AS value FROM w JOIN rollouts x ON x.row_id = w.first WHERE w.r = 1")
def maj_vote(spark, d):
    return M.majority(X.rollouts(spark, d).withColumn("pred", F.col("k") % 5), "uid", "pred", "score", "row_id")


@query(f"{R} SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(avg(score) FILTER (WHERE length > 5), 6) AS reward_mean, round(avg(length), 6) AS length_mean, max(length) AS length_max, round(avg((length >= 95)::INT), 6) AS clip_ratio, round(avg((length <= 5)::INT), 6) AS aborted_ratio, round(1 - var_samp(score - k / 20.0) / var_samp(score), 6) AS explained FROM rollouts")
def agg_data_metrics(spark, d):
    return M.batch_metrics(X.rollouts(spark, d), "score", "length", F.col("k") / 20.0, most=95, aborted=F.col("length") <= 5)


@query(f"{R}, t AS (SELECT data_source AS stage, sum(k) / 10.0 AS seconds, sum(length) AS tokens FROM rollouts GROUP BY 1) SELECT stage, round(seconds, 6) AS seconds, round(seconds * 1000 / tokens, 6) AS ms_per_token, round(tokens / (seconds * 8), 6) AS tokens_per_gpu_second FROM t")
def agg_timing_throughput(spark, d):
    t = X.rollouts(spark, d).groupBy(F.col("data_source").alias("stage")).agg((F.sum("k") / 10.0).alias("seconds"), F.sum("length").alias("tokens"))
    return t.select("stage", F.round("seconds", 6).alias("seconds"), F.round(F.try_divide(F.col("seconds") * 1000, F.col("tokens")), 6).alias("ms_per_token"), F.round(F.try_divide(F.col("tokens"), F.col("seconds") * 8), 6).alias("tokens_per_gpu_second"))


NAMES = "m AS (SELECT ['loss/mean', 'len/max', 'len/min', 'minmax_diff', 'speed'][(row_id % 5)::INT + 1] AS name, score AS v, row_id AS step, length AS w FROM rollouts)"


@query(f"{R}, {NAMES} SELECT name, round(CASE WHEN contains(name, 'max') THEN max(v) WHEN contains(name, 'min') THEN min(v) ELSE avg(v) END, 6) AS value FROM m GROUP BY 1")
def reduce_by_name(spark, d):
    return M.reduce_by_name(_named(spark, d), "name", "v")


@query(f"{R}, {NAMES} SELECT name, round(CASE name WHEN 'loss/mean' THEN sum(v * w) / sum(w) WHEN 'speed' THEN arg_max(v, step) WHEN 'len/max' THEN max(v) WHEN 'len/min' THEN min(v) ELSE sum(v) END, 5) AS value FROM m GROUP BY 1")
def agg_metrics_rules(spark, d):
    rules = {"loss/mean": "weighted_avg", "speed": "last", "len/max": "max", "len/min": "min", "minmax_diff": "sum"}
    return M.reduce_by_rule(_named(spark, d), "name", "v", "w", "step", rules)


def _named(spark, d):
    name = F.expr("element_at(array('loss/mean', 'len/max', 'len/min', 'minmax_diff', 'speed'), cast(row_id % 5 as int) + 1)")
    return X.rollouts(spark, d).select(name.alias("name"), F.col("score").alias("v"), F.col("row_id").alias("step"), F.col("length").alias("w"))


@query(f"{R} SELECT data_source AS category, count(DISTINCT uid) AS queries, count(DISTINCT uid) FILTER (WHERE acc = 1) AS matched_queries, count(*) AS rollouts, count(*) FILTER (WHERE acc = 1) AS matched FROM rollouts GROUP BY 1")
def agg_match_ratio(spark, d):
    return X.rollouts(spark, d).groupBy(F.col("data_source").alias("category")).agg(F.countDistinct("uid").alias("queries"), F.countDistinct(F.when(F.col("acc") == 1, F.col("uid"))).alias("matched_queries"), F.count("*").alias("rollouts"), F.count_if(F.col("acc") == 1).alias("matched"))


@query(f"WITH {X.STEPS} SELECT episode_id, count(*) FILTER (WHERE role = 'assistant') AS n, coalesce(string_agg(step::VARCHAR, ',' ORDER BY step) FILTER (WHERE role = 'assistant'), '') AS steps FROM steps GROUP BY 1")
def agg_fallbacks(spark, d):
    s = X.steps(spark, d).groupBy("episode_id").agg(F.count_if(F.col("role") == "assistant").alias("n"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("step")))).alias("s"))
    return s.select("episode_id", "n", F.array_join(F.col("s").cast("array<string>"), ",").alias("steps"))


@query(f"{R}, c AS (SELECT row_id % 8 AS part, sum(length) AS s FROM rollouts GROUP BY 1) SELECT min(s)::BIGINT AS lowest, max(s)::BIGINT AS highest, (max(s) - min(s))::BIGINT AS spread, round(avg(s), 6) AS mean FROM c")
def agg_seqlen_unbalance(spark, d):
    c = X.rollouts(spark, d).groupBy(F.col("row_id") % 8).agg(F.sum("length").alias("s"))
    return c.agg(F.min("s").alias("lowest"), F.max("s").alias("highest"), (F.max("s") - F.min("s")).alias("spread"), F.round(F.avg("s"), 6).alias("mean"))


@query(f"WITH {X.STEPS} SELECT episode_id, sum(CASE WHEN step > 1 THEN len(regexp_extract_all(action, '\\S+')) ELSE 0 END)::BIGINT AS words FROM steps GROUP BY 1")
def agg_token_amount(spark, d):
    """Words of all turns after the prompt."""
    words = F.when(F.col("step") > 1, F.size(F.regexp_extract_all("action", F.lit(r"\S+"), 0))).otherwise(0)
    return X.steps(spark, d).groupBy("episode_id").agg(F.sum(words).alias("words"))


# Weights of a conversation's measures; tokens count against it.
MEASURES = {"accuracy": 1.0, "bleu": 0.5, "pass_rate": 1.0, "interactivity": 0.3, "token_amount": -0.001}


def _bleu_sql(pairs):
    """BLEU of texts h against r by id, n-gram by n-gram."""
    return f"""{pairs}, sides AS (SELECT id, 1 AS own, h AS t FROM pairs UNION ALL SELECT id, 0, r FROM pairs), grams AS (SELECT id, own, n, substr(t, i::INT, n::INT) AS gram FROM (SELECT *, unnest(generate_series(1, length(t) - n + 1)) AS i FROM sides, generate_series(1, 4) g(n))),
 counts AS (SELECT id, n, gram, sum(own) AS h, sum(1 - own) AS r FROM grams GROUP BY 1, 2, 3), hits AS (SELECT id, n, sum(least(h, r)) AS hit, sum(h) AS total FROM counts GROUP BY 1, 2), logs AS (SELECT id, sum(ln(hit / total)) / 4 AS l FROM hits WHERE hit > 0 GROUP BY 1 HAVING count(*) = 4),
 bleus AS (SELECT id, coalesce(exp(l) * CASE WHEN length(h) > length(r) THEN 1 ELSE exp(1 - length(r) / length(h)) END, 0.0)::DOUBLE AS bleu FROM pairs LEFT JOIN logs USING (id))"""


@query("WITH " + _bleu_sql("pairs AS (SELECT conv_id * 1000 + turn AS id, text AS h, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations QUALIFY r IS NOT NULL)") + " SELECT id // 1000 AS conv_id, id % 1000 AS turn, round(bleu, 6) AS bleu FROM bleus")
def bleu_turns(spark, d):
    """BLEU of each turn against the turn before."""
    c = X.read(spark, d, "conversations")
    t = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    t = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "before")
    return M.bleu(t, "id", "text", "before").select(F.floor(F.col("id") / 1000).alias("conv_id"), (F.col("id") % 1000).alias("turn"), F.round("bleu", 6).alias("bleu"))


@query(f"WITH {X.STEPS}, " + _bleu_sql("pairs AS (SELECT episode_id AS id, arg_max(action, step) AS h, arg_min(action, step) AS r FROM steps GROUP BY 1)") + r""", m AS (SELECT episode_id, sum(CASE WHEN step > 1 THEN len(regexp_extract_all(action, '\S+')) ELSE 0 END)::DOUBLE AS token_amount, avg((role = 'assistant')::INT) AS interactivity FROM steps GROUP BY 1)
SELECT episode_id, round((episode_id % 2) + 0.5 * bleu + 1.0 * (episode_id % 5) / 4.0 + 0.3 * interactivity - 0.001 * token_amount, 6)::DOUBLE AS reward FROM m JOIN bleus ON id = episode_id""")
def agg_pass_rates(spark, d):
    """A conversation's reward: the weighted sum of its measures. Judges' measures are input columns; the tokens are counted, BLEU is that of the last turn against the first."""
    words = F.when(F.col("step") > 1, F.size(F.regexp_extract_all("action", F.lit(r"\S+"), 0))).otherwise(0)
    ends = [F.max_by("action", "step").alias("h"), F.min_by("action", "step").alias("r")]
    m = X.steps(spark, d).groupBy("episode_id").agg(F.sum(words).cast("double").alias("token_amount"), F.avg((F.col("role") == "assistant").cast("int")).alias("interactivity"), *ends)
    m = m.join(M.bleu(m, "episode_id", "h", "r"), "episode_id")
    m = m.withColumns({"accuracy": F.col("episode_id") % 2, "pass_rate": F.col("episode_id") % 5 / 4.0})
    return m.select("episode_id", F.round(M.weighted_sum(MEASURES), 6).alias("reward"))


@query(f"{R} SELECT data_source, min(k) AS gen_min, max(k) AS gen_max, round(avg(k), 6) AS gen_mean, round(avg(length), 6) AS tool_mean, arg_max(row_id, (k + length) * 1000000 - row_id) AS slowest FROM rollouts GROUP BY 1")
def agg_agent_loop(spark, d):
    r = X.rollouts(spark, d)
    slowest = F.max_by("row_id", F.struct(F.col("k") + F.col("length"), -F.col("row_id"))).alias("slowest")
    return r.groupBy("data_source").agg(F.min("k").alias("gen_min"), F.max("k").alias("gen_max"), F.round(F.avg("k"), 6).alias("gen_mean"), F.round(F.avg("length"), 6).alias("tool_mean"), slowest)


@query(f"{R}, o AS (SELECT row_id, row_number() OVER (PARTITION BY data_source ORDER BY length, row_id) - 1 AS i, count(*) OVER (PARTITION BY data_source) AS n FROM rollouts) SELECT row_id, CASE WHEN i % 2 = 0 THEN i / 2 ELSE n - 1 - (i - 1) / 2 END::BIGINT AS place FROM o")
def win_dense_rank_len(spark, d):
    """Within a part, short and long sequences alternate ends: even ranks go up, odd ranks come back."""
    r = X.rollouts(spark, d).select("row_id", "data_source", "length")
    o = ranked(r, "data_source", ["length", "row_id"], {"_length": F.col("length"), "_ids": F.floor(F.col("row_id") / (1 << 20))}, to="i")
    o = o.join(r.groupBy("data_source").agg(F.count("*").alias("n")), "data_source")
    place = F.when(F.col("i") % 2 == 0, F.floor(F.col("i") / 2)).otherwise(F.col("n") - 1 - F.floor((F.col("i") - 1) / 2))
    return o.select("row_id", place.cast("long").alias("place"))


@query(f"{R}, r AS (SELECT uid, score, row_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS rn FROM rollouts) SELECT uid, round(max(score) FILTER (WHERE rn = 1) - max(score) FILTER (WHERE rn = 2), 6) AS gap, max(row_id) FILTER (WHERE rn = 1) AS winner FROM r GROUP BY 1")
def win_topk_gap(spark, d):
    """The gap between a prompt's two best scores, and the best one's row; each task keeps two rows of a prompt before the shuffle."""
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "row_id")
    two = X.rollouts(spark, d).select("uid", "row_id", "score").withColumn("rn", F.row_number().over(best)).where("rn <= 2")
    of = lambda place, column: F.max(F.when(F.col("rn") == place, F.col(column)))
    return two.groupBy("uid").agg(F.round(of(1, "score") - of(2, "score"), 6).alias("gap"), of(1, "row_id").alias("winner"))


@query(f"{R}, d AS (SELECT row_id, uid, score, lead(score) OVER (PARTITION BY uid ORDER BY row_id) AS other, row_number() OVER (PARTITION BY uid ORDER BY row_id) AS n FROM rollouts) SELECT row_id, score >= other AS wins, round(-ln(1 / (1 + exp(-0.1 * (abs(score - other))))), 6) AS loss FROM d WHERE n % 2 = 1 AND other IS NOT NULL")
def dpo_pref_loss(spark, d):
    """Pairs of neighbouring responses: who wins (ties go to the first) and the preference loss of the gap.

    Rows are numbered in ranges of ids and paired by number, so that no task holds a prompt with very many responses.
    """
    o = ranked(X.rollouts(spark, d).select("uid", "row_id", "score"), "uid", ["row_id"], {"_range": F.floor(F.col("row_id") / 65_536)})
    of = lambda odd, column: F.max(F.when(F.col("pos") % 2 == odd, F.col(column)))
    p = o.groupBy("uid", F.floor(F.col("pos") / 2).alias("pair")).agg(of(0, "row_id").alias("row_id"), of(0, "score").alias("score"), of(1, "score").alias("other")).where("other IS NOT NULL")
    return p.select("row_id", (F.col("score") >= F.col("other")).alias("wins"), F.round(F.log1p(F.exp(-0.1 * F.abs(F.col("score") - F.col("other")))), 6).alias("loss"))
