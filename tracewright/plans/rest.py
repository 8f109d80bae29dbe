"""Queries of what the other modules leave: nested episodes, screenshots, choices, graded answers, batch-level losses, files."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import answers, symbolic
from tracewright.functions import scoring as S
from tracewright.functions import text as T
from tracewright.operators import advantage as A
from tracewright.operators import batch as B
from tracewright.operators import tokenwise as K
from tracewright.operators import trajectory as Y
from tracewright.operators.order import numbered, seeded
from tracewright.plans.advantages import R as GROUPS
from tracewright.plans.advantages import STATS, rows
from tracewright.plans.registry import query
from tracewright.sources import files
from tracewright.sources import fixtures as X

W = "WITH " + X.STEPS
R = "WITH " + X.ROLLOUTS
PAIRS = "WITH " + X.TOKEN_PAIRS


def nested(spark, d):
    """One row an episode with an array of steps, as trajectory files hold them."""
    s = X.steps(spark, d)
    plan = F.when(F.col("role") == "assistant", F.create_map(F.lit("action"), F.lit("click")))
    shot = F.when(F.col("step") % 4 != 0, F.concat(F.lit("s"), F.col("step").cast("string"), F.lit(".png"))).otherwise("")
    return s.groupBy("episode_id", "device").agg(F.array_sort(F.collect_list(F.struct("step", "role", shot.alias("screenshot")))).alias("data"), F.count(plan).alias("n_plans"))


@query(f"{W} SELECT episode_id, device, (row_number() OVER (PARTITION BY episode_id ORDER BY step) - 1)::INT AS pos, step, role FROM steps")
def explode_steps(spark, d):
    return nested(spark, d).select("episode_id", "device", F.posexplode("data").alias("pos", "s")).select("episode_id", "device", "pos", "s.step", "s.role")


@query(f"{W} SELECT episode_id, step FROM steps WHERE role = 'assistant' AND step % 4 <> 0")
def flt_has_plan_screenshot(spark, d):
    """Steps with a plan and a screenshot; an empty name is none."""
    s = nested(spark, d).select("episode_id", F.explode("data").alias("s")).select("episode_id", "s.*")
    plan = F.when(F.col("role") == "assistant", F.create_map(F.lit("action"), F.lit("click"))).otherwise(F.create_map().cast("map<string,string>"))
    return s.where((F.size(F.map_keys(plan)) > 0) & (F.length("screenshot") > 0)).select("episode_id", "step")


@query(f"{W}, f AS (SELECT episode_id, step FROM steps WHERE (episode_id + step) % 11 <> 0) SELECT episode_id, count(*) FILTER (WHERE f.step IS NULL) AS missing, bool_and(f.step IS NOT NULL) AS complete FROM steps s LEFT JOIN f USING (episode_id, step) GROUP BY 1")
def flt_screenshots(spark, d):
    """Episodes of which every step's file exists."""
    s = X.steps(spark, d).select("episode_id", "step")
    there = s.where((F.col("episode_id") + F.col("step")) % 11 != 0).withColumn("there", F.lit(True))
    j = s.join(there, ["episode_id", "step"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return j.groupBy("episode_id").agg(F.count_if(~F.col("there")).alias("missing"), F.bool_and("there").alias("complete"))


@query("SELECT doc_id FROM labels WHERE quality >= 1.0 AND toxic < 1")
def flt_score_threshold(spark, d):
    return X.read(spark, d, "labels").where("quality >= 1.0 AND toxic < 1").select("doc_id")


@query("SELECT item_id, 'user' AS role, 'Answer: ' || text AS content, item_id::VARCHAR AS ground_truth, 'benchmark' AS data_source FROM benchmark")
def prj_example_map(spark, d):
    """A source's rows in the canonical training form."""
    b = X.read(spark, d, "benchmark")
    rows_ = b.select(
        "item_id", F.lit("benchmark").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Answer: "), "text").alias("content"))).alias("prompt"),
        F.struct(F.col("item_id").cast("string").alias("ground_truth")).alias("reward_model"), F.struct(F.col("item_id").alias("index")).alias("extra_info"),
    )
    return rows_.select("item_id", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "data_source")


@query(f"{W} SELECT episode_id, step, CASE WHEN device = 'mobile' THEN 'Task: ' || role || '. Done so far: ' ELSE 'Instruction: ' || role || chr(10) || 'Previous: ' END || coalesce(string_agg('Step ' || step || ';', ' ') OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'None') AS prompt FROM steps")
def fn_user_prompt(spark, d):
    h = Y.history(X.steps(spark, d), F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(";")))
    past = F.when(F.col("history") == "", "None").otherwise(F.col("history"))
    head = F.when(F.col("device") == "mobile", F.concat(F.lit("Task: "), "role", F.lit(". Done so far: "))).otherwise(F.concat(F.lit("Instruction: "), "role", F.lit("\nPrevious: ")))
    return h.select("episode_id", "step", F.concat(head, past).alias("prompt"))


@query(f"""{W} SELECT episode_id, step, CASE WHEN episode_id % 2 = 0 THEN role END AS thought, CASE WHEN episode_id % 2 = 0 THEN 'do ' || step ELSE '' END AS action, CASE WHEN episode_id % 2 = 0 THEN '{{"name": "m' || step || '"}}' END AS func FROM steps""")
def fn_tva_extract(spark, d):
    """Thought, action and call of an answer; nulls and an empty action of a text without them."""
    made = F.expr("""CASE WHEN episode_id % 2 = 0 THEN concat('<think>', role, '\\n</think>\\nAction: do ', step, '\\n<tool_call>\\n{"name": "m', step, '"}\\n</tool_call>') ELSE concat('nothing ', role) END""")
    t = X.steps(spark, d).select("episode_id", "step", made.alias("t"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return t.select("episode_id", "step", strip(T.found(F.col("t"), r"(?s)<think>(.*?)</think>")).alias("thought"), T.action_description(F.col("t")).alias("action"), strip(T.found(F.col("t"), T.TOOL_CALL)).alias("func"))


@query(f"WITH {X.BOXES} SELECT l_orderkey, l_linenumber, l_partkey, trunc(x1 * 999 / 1080)::INT AS gx1, trunc(y2 * 999 / 2400)::INT AS gy2 FROM boxes")
def fn_dict_bbox(spark, d):
    """Pixel boxes on the 999 grid, cut off rather than rounded."""
    return X.boxes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("x1") * 999 / 1080).cast("int").alias("gx1"), (F.col("y2") * 999 / 2400).cast("int").alias("gy2"))


@query("SELECT p_partkey, round(6.0 * (p_size * 1e6) * 2048 + 12.0 * (p_size % 7 + 1) * 512 * 2048 * 2048, 0) AS flops FROM part")
def fn_flops(spark, d):
    """Training operations of a dense transformer: six for each parameter and token, twelve for each layer, width and pair of tokens."""
    p = X.read(spark, d, "part")
    return p.select("p_partkey", F.round(F.col("p_size") * 6e6 * 2048 + (F.col("p_size") % 7 + 1) * (12.0 * 512 * 2048 * 2048), 0).alias("flops"))


GRADED = r"""CASE l_linenumber % 5 WHEN 0 THEN concat('<think>x</think> \\boxed{\\frac{', 2 * l_partkey + 1, '}{2}}') WHEN 1 THEN concat('so \\boxed{', l_partkey, '}') WHEN 2 THEN concat('no box ', l_partkey)
 WHEN 3 THEN concat('<think>x</think> \\boxed{', l_partkey, '}') ELSE '\\boxed{True}' END"""
TRUTH = "CASE l_linenumber % 5 WHEN 0 THEN concat(l_partkey, '.5') WHEN 4 THEN 'True' ELSE string(2 * l_partkey + 1) END"


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 = 4 OR l_linenumber % 5 = 0 AND l_partkey = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS math, CASE l_linenumber % 5 WHEN 0 THEN 1.0 WHEN 3 THEN 0.1 WHEN 4 THEN 0.9 ELSE 0.0 END::DOUBLE AS geo3k, CASE WHEN l_linenumber % 5 IN (0, 4) THEN 1.0 ELSE 0.0 END::DOUBLE AS genrm_or_math FROM lineitem")
def score_math(spark, d):
    """The last boxed answer against the truth: the same in boxed form; 0.9 for one value and 0.1 for the form; a judge's boxed verdict."""
    t = X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(GRADED).alias("t"), F.expr(TRUTH).alias("truth")).withColumn("b", T.boxed("t"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    t = t.withColumn("math", flag(F.col("b").isNotNull() & answers.same_boxed(F.col("b"), F.col("truth")))).withColumn("right", flag(symbolic.right_answer(F.col("b"), F.col("truth"))))
    form = flag(F.regexp_like("t", F.lit(r"(?s)<think>.*</think>.*\\boxed\{.*\}.*")))
    verdict = F.when(F.col("b") == "True", 1.0).otherwise(F.col("right"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "math", F.round(F.col("right") * 0.9 + form * 0.1, 6).alias("geo3k"), verdict.alias("genrm_or_math"))


@query(f"{R} SELECT row_id, 1 + (row_number() OVER (PARTITION BY row_id ORDER BY h, c) - 1) AS place, c AS choice FROM (SELECT row_id, c, md5('9:' || row_id || ':' || c) AS h FROM rollouts, (VALUES ('gold'), ('w1'), ('w2'), ('w3')) v(c))")
def shuffle_choices(spark, d):
    """A question's choices in a hashed order of its own."""
    r = X.rollouts(spark, d).select("row_id", F.array(*[F.lit(c) for c in ("gold", "w1", "w2", "w3")]).alias("cs"))
    order = F.array_sort(F.transform("cs", lambda c: F.struct(F.md5(F.concat_ws(":", F.lit("9"), F.col("row_id").cast("string"), c)).alias("h"), c.alias("c"))))
    return r.select("row_id", F.posexplode(order).alias("p", "o")).select("row_id", (F.col("p") + 1).cast("long").alias("place"), F.col("o.c").alias("choice"))


@query("WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, pos + 2 AS pos FROM p UNION ALL SELECT s_suppkey, k FROM p, (VALUES (0), (1)) a(k) WHERE pos = 0 UNION ALL SELECT s_suppkey, n + 2 + k FROM p, (VALUES (0), (1), (2)) b(k) WHERE pos = n - 1")
def pad_first_last(spark, d):
    """Two copies of the first row before, three of the last after."""
    p = numbered(X.read(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    n = X.read(spark, d, "supplier").count()
    first = B.repeated(p.where("pos = 0"), 2).select("s_suppkey", (F.col("rep") - 1).cast("long").alias("pos"))
    last = B.repeated(p.where(F.col("pos") == n - 1), 3).select("s_suppkey", (F.lit(n + 1) + F.col("rep")).cast("long").alias("pos"))
    return p.select("s_suppkey", (F.col("pos") + 2).alias("pos")).unionByName(first).unionByName(last)


@query("WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier), i AS (SELECT n_nationkey AS place, (n_nationkey * 7) % 25 AS pos FROM nation) SELECT place, s_suppkey FROM i JOIN p USING (pos)")
def reorder_rows(spark, d):
    """Rows picked and put in order by a table of positions."""
    p = numbered(X.read(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    index = X.read(spark, d, "nation").select(F.col("n_nationkey").alias("place"), (F.col("n_nationkey") * 7 % 25).alias("pos"))
    return index.join(p, "pos").select("place", "s_suppkey")


@query(f"{W} SELECT device, count(*) FILTER (WHERE is_use = false) AS marked FROM steps GROUP BY 1 ORDER BY marked DESC")
def sort_desc_marked(spark, d):
    return X.steps(spark, d).groupBy("device").agg(F.count_if(~F.col("is_use")).alias("marked")).orderBy(F.desc("marked"))


@query(f"WITH {X.BOXES}, p AS (SELECT l_orderkey % 8 AS worker, count(*) AS n, count(*) FILTER (WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2) AS c FROM boxes GROUP BY 1) SELECT sum(n)::BIGINT AS n, sum(c)::BIGINT AS correct, round(sum(c) / sum(n), 6)::DOUBLE AS accuracy FROM p")
def agg_allreduce_counts(spark, d):
    """Workers' counters summed; the same as one grouped pass, which Spark combines by task anyway."""
    from tracewright.plans.metrics import hits

    p = hits(spark, d).groupBy(F.col("l_orderkey") % 8).agg(F.count("*").alias("n"), F.count_if("hit").alias("c"))
    return p.agg(F.sum("n").alias("n"), F.sum("c").alias("correct"), F.round(F.sum("c") / F.sum("n"), 6).alias("accuracy"))


@query(f"{GROUPS}, s AS (SELECT uid, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM g GROUP BY 1) SELECT uid, n, round(CASE WHEN n = 1 THEN 0 ELSE m END, 6) AS mean, round(CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(v, 1e-6)) END, 6) AS deviation FROM s")
def group_mean_std(spark, d):
    return A.with_stats(rows(spark, d), floor=1e-6).select("uid", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation")).distinct()


@query(f"WITH {X.TOKENS}, f AS (SELECT id, min(t) FILTER (WHERE x < -0.2) AS mark, sum(m) AS n FROM tokens GROUP BY 1) SELECT f.id, sum(CASE WHEN mark IS NULL OR t > mark THEN m ELSE 0 END)::INT AS n FROM tokens JOIN f USING (id) GROUP BY 1")
def win_action_only_mask(spark, d):
    """The mask after the closing mark of a thought; the whole mask without one."""
    t = X.tokens(spark, d)
    after = K.last_after_marker(F.transform("x", lambda v: F.when(v < -0.2, 1).otherwise(0)), F.lit(1))
    return t.select("id", K.add(F.zip_with(after, "m", lambda a, m: a * m)).cast("int").alias("n"))


@query(f"WITH {X.TOKENS}, p AS (SELECT a.id, a.t, sum(pow(0.95, b.t - a.t) * b.x) AS g FROM tokens a JOIN tokens b ON a.id = b.id AND b.t >= a.t AND b.m = 1 WHERE a.m = 1 GROUP BY 1, 2), s AS (SELECT avg(g) AS mean, var_samp(g) AS v FROM p) SELECT id, round(sum((g - mean) / sqrt(v + 1e-8)), 3) AS total FROM p, s GROUP BY 1")
def adv_rf_pp(spark, d):
    """Discounted returns, whitened over the batch's unmasked tokens."""
    t = X.tokens(spark, d).withColumn("g", K.discounted("x", "m", 0.95))
    s = t.agg(F.sum(K.add("m")).alias("n"), F.sum(K.masked_sum("g", "m")).alias("s"), F.sum(K.masked_sum(F.transform("g", lambda v: v * v), F.col("m"))).alias("q"))
    s = s.select((F.col("s") / F.col("n")).alias("mean"), F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) + 1e-8).alias("sd"))
    t = t.crossJoin(F.broadcast(s))
    return t.select("id", F.round(K.masked_sum(F.transform("g", lambda v: (v - F.col("mean")) / F.col("sd")), F.col("m")), 3).alias("total"))


GRPO = "(score - mean) / (sd + 1e-6)"
ADVANTAGES = {
    "gpg": "(SELECT count(*)::DOUBLE / greatest(count(*) FILTER (WHERE score <> 0), 1) FROM g) * (score - mean)", "grpo": GRPO, "grpo_vectorized": "(score - mean) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(v, 1e-6)) END + 1e-6)",
    "grpo_passk": "CASE WHEN rn = 1 THEN (score - next) / (sqrt(v) + 1e-6) WHEN n > 1 THEN 0 END", "opo": "score - base", "rloo": "CASE WHEN n > 1 THEN (score - m) * n / (n - 1) ELSE score END",
}
DISPATCHED = f"{STATS}, r AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS next, avg(score) OVER w AS m, sum(score * length) OVER w / sum(length) OVER w AS base FROM s WINDOW o AS (PARTITION BY uid ORDER BY score DESC, row_id), w AS (PARTITION BY uid)) "


@query(DISPATCHED + " UNION ALL ".join(f"SELECT '{k}' AS name, row_id, round({v}, 6) AS advantage FROM r" for k, v in ADVANTAGES.items()))
def adv_dispatch(spark, d):
    """Every estimator by its name: each row's advantage."""
    r, out = rows(spark, d), None
    for name, make in sorted(A.ESTIMATORS.items()):
        one = make(r).select(F.lit(name).alias("name"), "row_id", F.round("advantage", 6).alias("advantage"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{PAIRS} SELECT id, round(sum((0.5 - 0.05 * (a - b)) * m), 5) AS rewards FROM pairs GROUP BY 1")
def rewards_kl(spark, d):
    p = X.token_pairs(spark, d)
    return p.select("id", F.round(K.masked_sum(F.zip_with("a", "b", lambda a, b: F.lit(0.5) - (a - b) * 0.05), F.col("m")), 5).alias("rewards"))


@query(f"{PAIRS}, s AS (SELECT id, sum(greatest(-20, least(20, a - b)) * m) AS l, sum(m) AS n, count(*) FILTER (WHERE m = 1 AND exp(a - b) BETWEEN 0.8 AND 1.25) AS kept_tokens FROM pairs GROUP BY 1) SELECT round(sum(kept_tokens) / sum(n), 6)::DOUBLE AS token_kept, round(avg((exp(greatest(-20, least(20, l))) BETWEEN 0.5 AND 2)::INT), 6) AS sequence_kept, round(avg((exp(l / n) BETWEEN 0.98 AND 1 / 0.98)::INT), 6) AS geometric_kept FROM s")
def rs_metrics(spark, d):
    """Shares of what rejection keeps: tokens, sequences, and sequences by geometric mean."""
    p = X.token_pairs(spark, d).withColumn("l", F.zip_with("a", "b", lambda a, b: K.clamped(a - b, -20.0, 20.0)))
    kept = K.masked_sum(F.transform("l", lambda v: F.when(F.exp(v).between(0.8, 1.25), 1.0).otherwise(0.0)), F.col("m"))
    s = p.select(kept.alias("kept"), K.add("m").alias("n"), K.masked_sum("l", "m").alias("l"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return s.agg(F.round(F.sum("kept") / F.sum("n"), 6).alias("token_kept"), share(F.exp(K.clamped(F.col("l"), -20.0, 20.0)).between(0.5, 2.0)).alias("sequence_kept"), share(F.exp(F.col("l") / F.col("n")).between(0.98, 1 / 0.98)).alias("geometric_kept"))


@query(f"{PAIRS}, w AS (SELECT id, t, m, advantage, a, exp(greatest(-20, least(20, a - b))) AS r FROM pairs), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('5:' || id || ':' || t)) AS n FROM w WHERE m = 1 AND abs(advantage * a) BETWEEN 0.1 AND 0.6), c AS (SELECT id, t FROM k WHERE n <= 3) SELECT w.id, round(sum(CASE WHEN c.t IS NULL THEN greatest(-advantage * r, -advantage * greatest(0.8, least(1.2, r))) ELSE 0 END * m) / sum(m) + 0.0, 5) AS loss FROM w LEFT JOIN c ON w.id = c.id AND w.t = c.t GROUP BY 1")
def loss_clip_cov(spark, d):
    """The clipped loss without three tokens a sequence, picked by hash among those of middling covariance."""
    p = X.token_pairs(spark, d)
    rows_ = F.transform(F.arrays_zip("a", "b", "m"), lambda x, t: F.struct(t.alias("t"), x["a"].alias("a"), x["m"].alias("m"), K.ratio(x["a"], x["b"]).alias("r"), F.md5(F.concat_ws(":", F.lit("5"), F.col("id").cast("string"), t.cast("string"))).alias("h")))
    p = p.withColumn("x", rows_)
    middling = F.filter("x", lambda v: (v["m"] > 0) & F.abs(F.col("advantage") * v["a"]).between(0.1, 0.6))
    p = p.withColumn("gone", F.slice(F.array_sort(F.transform(middling, lambda v: F.struct(v["h"].alias("h"), v["t"].alias("t")))), 1, 3))
    adv = F.col("advantage")
    each = F.transform("x", lambda v: F.when(F.exists("gone", lambda g: g["t"] == v["t"]), 0.0).otherwise(F.greatest(-adv * v["r"], -adv * K.clamped(v["r"], 0.8, 1.2)) * v["m"]))
    return p.select("id", F.round(K.add(each) / K.add("m") + 0.0, 5).alias("loss"))


@query(f"{PAIRS}, w AS (SELECT id, m, advantage, a, exp(greatest(-20, least(20, a - b))) AS r FROM pairs), s AS (SELECT id, sum(ln(r) * m) / sum(m) AS g FROM w GROUP BY 1) SELECT w.id, round(sum(-advantage * least(r, 2.0) * a * m) / sum(m) * max((exp(g) BETWEEN 0.99 AND 1 / 0.99)::INT) + 0.0, 5) AS loss FROM w JOIN s USING (id) GROUP BY 1")
def loss_bypass(spark, d):
    """Policy gradient with truncated weights on sequences that geometric rejection keeps."""
    p = X.token_pairs(spark, d).withColumn("l", F.zip_with("a", "b", lambda a, b: K.clamped(a - b, -20.0, 20.0)))
    n, adv = K.add("m"), F.col("advantage")
    kept = F.exp(K.masked_sum("l", "m") / n).between(0.99, 1 / 0.99).cast("int")
    loss = K.masked_sum(F.zip_with("l", "a", lambda l, a: -adv * F.least(F.exp(l), F.lit(2.0)) * a), F.col("m")) / n
    return p.select("id", F.round(loss * kept + 0.0, 5).alias("loss"))


@query(f"{R}, b AS (SELECT *, floor(row_id / 8)::BIGINT AS block FROM rollouts) SELECT x.block, round(avg(((x.score > y.score AND x.k > y.k) OR (x.score <= y.score AND x.k <= y.k))::INT), 6) AS accuracy FROM b x JOIN b y ON x.block = y.block AND x.row_id < y.row_id GROUP BY 1")
def dpo_acc(spark, d):
    """How often two responses of a block of eight are in the same order by both measures: pairs inside the row of a block."""
    b = B.folded(X.rollouts(spark, d).select("row_id", "score", "k"), "row_id", 8, "score", "k").withColumn("x", F.arrays_zip("score", "k"))
    n = F.size("x")
    later = lambda i: F.when(i < n, F.slice("x", i + 1, n)).otherwise(F.slice("x", 1, 0))
    same = lambda p, q: F.when((p["score"] > q["score"]) == (p["k"] > q["k"]), 1.0).otherwise(0.0)
    pairs_ = F.flatten(F.transform("x", lambda p, i: F.transform(later(i + 1), lambda q: same(p, q))))
    return b.where(n > 1).select("block", F.round(F.aggregate(pairs_, F.lit(0.0), lambda a, v: a + v) / F.size(pairs_), 6).alias("accuracy"))


@query(f"{R} SELECT row_id, round(score, 6) AS naive, round(CASE WHEN data_source = 'error' THEN 0 ELSE score END, 6) AS guarded, round(score + least(-(length - 68) / 32.0, 0), 6) AS shaped FROM rollouts")
def reward_managers(spark, d):
    """Scores placed as they are, 0 where scoring failed, and with the length penalty."""
    from tracewright.functions.geometry import overlong_penalty

    r = X.rollouts(spark, d)
    failed = F.when(F.col("data_source") != "error", F.col("score"))
    return r.select("row_id", F.round("score", 6).alias("naive"), F.round(F.coalesce(failed, F.lit(0.0)), 6).alias("guarded"), F.round(F.col("score") + overlong_penalty(F.col("length"), 100, 32), 6).alias("shaped"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'error' WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS precondition, CASE WHEN toxic = 1 THEN 'mark' ELSE 'leave' END AS duplicate FROM documents LEFT JOIN labels USING (doc_id)")
def judge_verdicts(spark, d):
    """What judges' verdicts do: keep, drop or error; mark or leave."""
    j = X.read(spark, d, "documents").select("doc_id").join(X.read(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "error").when(F.col("quality") == 1, "keep").otherwise("drop").alias("precondition"), F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)), "mark").otherwise("leave").alias("duplicate"))


# ---- files: written to the shared folder and read back ----


def _folder(spark):
    from tracewright.streaming.place import shared_dir

    return shared_dir(spark)


@query(f"{W} SELECT episode_id, device, count(*) AS n, min(step) AS first, max(step) AS last FROM steps GROUP BY 1, 2")
def scan_task_json(spark, d):
    """Episodes written as task.json below a folder each, found by a walk and exploded again."""
    root = _folder(spark)
    e = X.steps(spark, d).groupBy("episode_id", "device").agg(F.array_sort(F.collect_list(F.struct("step", "action", "is_use"))).alias("data"))
    line = F.to_json(F.struct(F.col("episode_id").cast("string").alias("episode_id"), "device", "data")).alias("value")
    e.select(line, F.col("episode_id").alias("app")).write.partitionBy("app").text(root)
    read = files.exploded(files.read_episodes(spark, root, "*.txt"))
    return read.groupBy(F.col("episode_id").cast("long").alias("episode_id"), "device").agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last"))


@query(f"{W} SELECT step AS step_num, count(*) AS n FROM steps WHERE step % 5 <> 0 GROUP BY 1")
def scan_jsonl_lenient(spark, d):
    """Log lines of which every fifth step's is broken: those are left out."""
    root = _folder(spark)
    s = X.steps(spark, d)
    line = F.to_json(F.struct(F.col("step").alias("step_num"), "action"))
    s.select(F.when(F.col("step") % 5 == 0, "{broken").otherwise(line).alias("value")).write.text(root)
    return files.read_json_lines(spark, root, "*.txt").groupBy("step_num").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey % 50 AS step, count(*) AS n, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY 1")
def scan_rollout_dumps(spark, d):
    """Rollouts dumped as JSON lines by step and read back."""
    root = _folder(spark)
    o = X.read(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("step"), F.col("o_totalprice").alias("score"))
    files.write_json(o.repartition("step"), root, "step")
    back = spark.read.schema("score double, step long").json(root)
    return back.groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


@query(f"WITH {X.BOXES} SELECT l_orderkey, l_linenumber, l_partkey, px + x1 AS x2, py + y1 AS y2 FROM boxes")
def scan_annotations(spark, d):
    """Boxes given by corner and size, read from JSON in corner form."""
    root = _folder(spark)
    b = X.boxes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.array("px", "py", "x1", "y1").alias("bbox"))
    b.write.json(root)
    a = files.boxed(spark.read.schema("l_orderkey long, l_linenumber int, l_partkey long, bbox array<double>").json(root), "bbox", "xywh")
    return a.select("l_orderkey", "l_linenumber", "l_partkey", F.col("box")[2].alias("x2"), F.col("box")[3].alias("y2"))


@query("SELECT c_custkey::VARCHAR AS task_id, c_name AS instruction, '' AS domain FROM customer")
def scan_csv_tasks(spark, d):
    """A task list written as CSV and read with its defaults."""
    root = _folder(spark)
    X.read(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("original_query")).write.option("header", True).csv(root)
    return files.csv_tasks(spark, root).select("task_id", "instruction", "domain")


@query(f"{R}, o AS (SELECT uid, acc, row_number() OVER (PARTITION BY uid ORDER BY row_id) AS n FROM rollouts) SELECT uid, count(*) AS seen FROM o GROUP BY 1")
def checkpoint_state(spark, d):
    """A sampler's state saved at two steps; the later one comes back."""
    root = _folder(spark)
    r = X.rollouts(spark, d)
    files.save_state(r.where("row_id < 100").groupBy("uid").agg(F.count("*").alias("seen")), root, 1)
    files.save_state(r.groupBy("uid").agg(F.count("*").alias("seen")), root, 2)
    return files.latest_state(spark, root)


@query(f"{GROUPS} SELECT DISTINCT uid FROM g WHERE length <= 1024")
def st_dynamic_dataset(spark, d):
    """A table that grows by four batches, each a share of the range of ids and filtered by length before it is appended."""
    root = _folder(spark)
    r = rows(spark, d).select("uid", "row_id", "length")
    low, high = r.agg(F.min("row_id").cast("double"), F.max("row_id").cast("double")).first()
    share = F.floor((F.col("row_id").cast("double") - F.lit(low)) * 4 / F.lit((high or 0.0) - (low or 0.0) + 1.0))
    r = r.withColumn("batch", F.coalesce(F.least(share, F.lit(3)), F.lit(0)))
    for k in range(4):
        files.grow(r.where(F.col("batch") == k).drop("batch"), root, 1024)
    return spark.read.schema(r.drop("batch").schema).parquet(root).select("uid").distinct()


# ---- files of the formats that tools write, one for each episode ----


def _episode_files(spark, d, name, content, root, *folders):
    """A file for each episode, below the folders made from its columns."""
    e = X.steps(spark, d).groupBy("episode_id", "device").agg(F.array_sort(F.collect_list(F.struct("step", "role"))).alias("data"))
    path = F.concat_ws("/", *folders, F.concat(F.lit("e"), F.col("episode_id").cast("string")), F.lit(name))
    files.write_files(e.select(path.alias("path"), content.alias("content")), root)


def _episode(column):
    return F.regexp_extract(column, r"/e(\d+)(?:/|$)", 1).cast("long").alias("episode_id")


@query(f"{W} SELECT episode_id, CASE WHEN episode_id % 2 = 0 THEN device END AS app, count(*) AS n FROM steps GROUP BY 1, 2")
def scan_two_level(spark, d):
    """Trajectories in root/app/episode and in root/episode: app and episode come from the path."""
    root = _folder(spark)
    content = F.to_json(F.struct("device", F.transform("data", lambda s: F.struct(s["step"].alias("step"), s["role"].alias("action"))).alias("data")))
    _episode_files(spark, d, "task.json", content, root, F.when(F.col("episode_id") % 2 == 0, F.concat(F.lit("two/"), "device")).otherwise(F.lit("one")))
    deep = files.placed(files.episodes(spark, f"{root}/two"), 2)
    flat = files.placed(files.episodes(spark, f"{root}/one"), 1)
    both = deep.unionByName(flat)
    return both.select(F.substring("folder_episode", 2, 20).cast("long").alias("episode_id"), F.col("folder_app").alias("app"), F.size("data").cast("long").alias("n"))


@query(f"{W} SELECT episode_id, step, role FROM steps WHERE step % 2 = 1")
def scan_traj_json(spark, d):
    """Steps of the first run of each mobile log; the second run, with the even steps, is left out."""
    root = _folder(spark)
    run = lambda odd: F.create_map(F.lit("traj"), F.transform(F.filter("data", lambda s: s["step"] % 2 == odd), lambda s: F.struct(s["step"].alias("step"), s["role"].alias("prediction"))))
    _episode_files(spark, d, "traj.json", F.to_json(F.create_map(F.lit("0"), run(1), F.lit("1"), run(0))), root)
    return files.mobile_logs(spark, root).select(_episode(F.col("file")), "step", F.col("prediction").alias("role"))


@query(f"{W}, e AS (SELECT DISTINCT episode_id FROM steps) SELECT episode_id, CASE WHEN episode_id % 3 = 1 THEN 0.0 ELSE episode_id % 7 / 4.0 END::DOUBLE AS score, CASE WHEN episode_id % 3 = 1 THEN episode_id % 7 / 4.0 END::DOUBLE AS labelled FROM e")
def scan_result_score(spark, d):
    """Scores of result files: a plain number (0 for what is none), or after a label (null without it)."""
    root = _folder(spark)
    number = (F.col("episode_id") % 7 / 4.0).cast("string")
    _episode_files(spark, d, "result.txt", F.when(F.col("episode_id") % 3 == 1, F.concat(F.lit("score: "), number)).otherwise(F.concat(number, F.lit("\n"))), root)
    plain, labelled = files.results(spark, root), files.results(spark, root, labelled=True).withColumnRenamed("score", "labelled")
    return plain.join(labelled, "folder").select(_episode(F.col("folder")), "score", "labelled")


@query(f"{W} SELECT episode_id, step AS run, (step * 3)::INT AS step FROM steps")
def scan_screenshots(spark, d):
    """Run and step from the names of screenshots; contents aren't read."""
    root = _folder(spark)
    s = X.steps(spark, d)
    name = F.concat(F.lit("e"), F.col("episode_id").cast("string"), F.lit("/shot-"), F.col("step").cast("string"), F.lit("-"), (F.col("step") * 3).cast("string"), F.lit(".png"))
    files.write_files(s.select(name.alias("path"), F.lit("x").alias("content")), root)
    return files.screenshots(spark, root).select(_episode(F.col("file")), "run", "step")


@query(f"{W}, c AS (SELECT 'Task' || step AS name, device || '_' || episode_id % 9 AS app FROM steps) SELECT name, min(app) AS app FROM c GROUP BY 1")
def scan_app_definitions(spark, d):
    """Classes in Python files with their folder; of a name that is in several, the first path wins."""
    root = _folder(spark)
    app = F.concat("device", F.lit("_"), (F.col("episode_id") % 9).cast("string"))
    c = X.steps(spark, d).select(app.alias("app"), "step").distinct().groupBy("app").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    content = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("class Task"), s.cast("string"), F.lit("(Base):\n    pass\n"))), "\n")
    files.write_files(c.select(F.concat("app", F.lit("/tasks.py")).alias("path"), content.alias("content")), root)
    return files.app_definitions(spark, root)


@query(f"{W} SELECT episode_id, step FROM steps ORDER BY episode_id, step LIMIT 100")
def scan_jsonl_strict(spark, d):
    """The first hundred lines, in order, of logs of which every line must be sound."""
    root = _folder(spark)
    X.steps(spark, d).select(F.to_json(F.struct("episode_id", "step")).alias("value")).write.text(root)
    return files.read_json_lines(spark, root, "*.txt", "episode_id long, step int", strict=True).select("episode_id", "step").orderBy("episode_id", "step").limit(100)
