"""Queries over trajectories: cleaning rules, history windows, splits."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import trajectory as T
from tracewright.operators.order import latest, numbered, seeded
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X

W = "WITH " + X.STEPS
HIST = "coalesce(array_to_string(list('Step ' || (step + CASE WHEN device = 'desktop' THEN 1 ELSE 0 END) || ': ' || coalesce(action, '') || ';') OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' '), '')"


@query(f"""{W}, h AS (SELECT *, {HIST} AS history FROM steps),
facts AS (SELECT episode_id FROM steps GROUP BY 1 HAVING min(step) = 1 AND max(step) = count(*) AND count(*) <= 40),
ranked AS (SELECT episode_id, row_number() OVER (ORDER BY md5('42:' || episode_id), episode_id) AS n FROM (SELECT DISTINCT episode_id FROM facts))
SELECT h.episode_id, h.step, h.history, 'Query: ' || h.role || chr(10) || 'History: ' || h.history AS prompt,
       '<think>' || h.role || '</think>' || chr(10) || 'Action: ' || h.action AS ground_truth, CASE WHEN r.n <= 30 THEN 'test' ELSE 'train' END AS split
FROM h JOIN facts f ON h.episode_id = f.episode_id JOIN ranked r ON r.episode_id = h.episode_id
WHERE coalesce(is_use, true) AND NOT coalesce(is_delete, false)""")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """From steps to training rows: history over all steps, then usable steps of sound episodes, prompts and a split."""
    s = X.steps(spark, d)
    sound = T.episode_facts(s).where(F.col("contiguous") & (F.col("n_steps") <= T.MAX_STEPS)).select("episode_id")
    rows = T.history(s, T.step_line(F.when(F.col("device") == "desktop", 1).otherwise(0))).join(sound, "episode_id")
    rows = T.split_first(rows, "episode_id", 30).where(T.usable())
    prompt = F.concat(F.lit("Query: "), "role", F.lit("\nHistory: "), "history")
    truth = F.concat(F.lit("<think>"), "role", F.lit("</think>\nAction: "), "action")
    return rows.select("episode_id", "step", "history", prompt.alias("prompt"), truth.alias("ground_truth"), "split")


@query(f"{W} SELECT episode_id, step, {HIST} AS history FROM steps")
def win_history(spark, d):
    return T.history(X.steps(spark, d), T.step_line(F.when(F.col("device") == "desktop", 1).otherwise(0))).select("episode_id", "step", "history")


@query(f"""{W} SELECT episode_id, step, coalesce(len(list(action) OVER w), 0) AS n_before, coalesce(array_to_string(list('Step ' || rn || ': ' || action) OVER w, chr(10)), '') AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY step) AS rn FROM steps) WINDOW w AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win_history_raw(spark, d):
    s = X.steps(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("episode_id").orderBy("step")))
    lines = F.collect_list(F.concat(F.lit("Step "), F.col("rn").cast("string"), F.lit(": "), "action")).over(T.within(after=-1))
    return s.withColumn("l", lines).select("episode_id", "step", F.size("l").cast("long").alias("n_before"), F.array_join("l", "\n").alias("lines"))


@query(f"""{W} SELECT episode_id, cur AS step, string_agg(CASE WHEN step = cur THEN '> ' ELSE '  ' END || step || ' ' || substr(action, 1, 150), chr(10) ORDER BY step) AS context FROM (
  SELECT a.episode_id, a.step AS cur, b.step, b.action FROM steps a JOIN steps b ON a.episode_id = b.episode_id AND b.step BETWEEN a.step - 5 AND a.step + 5) GROUP BY episode_id, cur""")
def win_context(spark, d):
    near = F.collect_list(F.struct("step", F.substring("action", 1, 150).alias("a"))).over(T.within(before=5, after=5))
    s = X.steps(spark, d).withColumn("near", near)
    line = lambda x: F.concat(F.when(x["step"] == F.col("step"), "> ").otherwise("  "), x["step"].cast("string"), F.lit(" "), x["a"])
    return s.select("episode_id", "step", F.array_join(F.transform("near", line), "\n").alias("context"))


@query(f"{W} SELECT episode_id, step, array_to_string(list(step) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS shots FROM steps")
def win_shots(spark, d):
    near = F.array_join(F.collect_list(F.col("step").cast("string")).over(T.within(before=2, after=2)), ",")
    return X.steps(spark, d).withColumn("shots", near).select("episode_id", "step", "shots")


def _episode_steps(spark, d):
    return X.steps(spark, d).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.col("step"))).alias("s"))


@query(f"{W}, r AS (SELECT episode_id, step, row_number() OVER (PARTITION BY episode_id ORDER BY step) a, row_number() OVER (PARTITION BY episode_id ORDER BY step DESC) z FROM steps) SELECT episode_id, string_agg(step::VARCHAR, ',' ORDER BY step) AS shots FROM r WHERE a = 1 OR z <= 3 GROUP BY 1")
def win_first_last_k(spark, d):
    return _episode_steps(spark, d).select("episode_id", F.array_join(T.first_and_last("s", 3).cast("array<string>"), ",").alias("shots"))


@query(f"""{W}, l AS (SELECT episode_id, list(step ORDER BY step) AS s FROM steps GROUP BY 1)
SELECT episode_id, array_to_string(CASE WHEN len(s) <= 5 THEN s ELSE list_transform([0, 1, 2, 3, 4], lambda i: s[CASE WHEN i = 4 THEN len(s) ELSE floor(i * (len(s) - 1) / 4.0)::INT + 1 END]) END, ',') AS picks FROM l""")
def win_uniform_k(spark, d):
    return _episode_steps(spark, d).select("episode_id", F.array_join(T.evenly_spaced("s", 5).cast("array<string>"), ",").alias("picks"))


@query(f"{W} SELECT episode_id, step, coalesce(array_to_string(list(step || '. ' || role || ' - ' || substr(action, 1, 80)) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), chr(10)), '') AS results FROM steps")
def win_prev_results(spark, d):
    line = F.concat(F.col("step").cast("string"), F.lit(". "), "role", F.lit(" - "), F.substring("action", 1, 80))
    return T.history(X.steps(spark, d), line, "results", "\n").select("episode_id", "step", "results")


@query(f"{W} SELECT episode_id, step FROM steps WHERE coalesce(is_use, true) AND NOT coalesce(is_delete, false)")
def flt_usable(spark, d):
    return X.steps(spark, d).where(T.usable()).select("episode_id", "step")


@query(f"{W} SELECT episode_id, step, role FROM steps WHERE is_use IS DISTINCT FROM false AND length(action) > 0 AND role <> 'system'")
def needs_bbox(spark, d):
    s = X.steps(spark, d)
    return s.where(~F.col("is_use").eqNullSafe(F.lit(False)) & (F.length("action") > 0) & (F.col("role") != "system")).select("episode_id", "step", "role")


FACTS = f"""{W}, facts AS (SELECT episode_id, count(*) AS n_steps, (min(step) = 1 AND max(step) = count(*) AND count(DISTINCT step) = count(*)) AS contiguous,
  arg_max(role, step) AS last_role, arg_max(action, step) AS last_action FROM steps WHERE step <> 3 OR episode_id % 7 <> 0 GROUP BY 1)"""


def _facts(spark, d):
    """Every seventh episode lacks its third step here, so that the rules have something to find."""
    return T.episode_facts(X.steps(spark, d).where((F.col("step") != 3) | (F.col("episode_id") % 7 != 0)))


@query(f"{FACTS} SELECT episode_id, n_steps FROM facts WHERE n_steps <= 6")
def flt_max_steps(spark, d):
    return _facts(spark, d).where("n_steps <= 6").select("episode_id", "n_steps")


@query(f"{FACTS} SELECT episode_id, contiguous FROM facts")
def flt_contiguous(spark, d):
    return _facts(spark, d).select("episode_id", "contiguous")


@query(f"{FACTS} SELECT episode_id, last_role FROM facts WHERE last_role = 'assistant'")
def flt_terminal(spark, d):
    return _facts(spark, d).where("last_role = 'assistant'").select("episode_id", "last_role")


REASON = """CASE WHEN n_steps > 6 THEN 'too_many_steps:' || n_steps WHEN NOT contiguous THEN 'step_not_continuous' WHEN last_role <> 'assistant' THEN 'last_not_status:' || last_role WHEN length(last_action) < 40 THEN 'action_invalid:short' END"""


def _reasons(spark, d):
    rules = [
        ("too_many_steps", F.col("n_steps") > 6),
        ("step_not_continuous", ~F.col("contiguous")),
        ("last_not_status", F.col("last_role") != "assistant"),
        ("action_invalid", F.length("last_action") < 40),
    ]
    detail = F.when(F.col("n_steps") > 6, F.col("n_steps").cast("string")).when(~F.col("contiguous"), None).when(F.col("last_role") != "assistant", F.col("last_role")).otherwise("short")
    first = T.first_failing(rules)
    return _facts(spark, d).withColumn("reason", F.when(first.isNotNull(), F.concat_ws(":", first, detail)))


@query(f"{FACTS} SELECT episode_id, {REASON} AS reason FROM facts")
def first_failing_reason(spark, d):
    return _reasons(spark, d).select("episode_id", "reason")


@query(f"{FACTS} SELECT coalesce(split_part({REASON}, ':', 1), 'kept') AS bucket, count(*) AS n FROM facts GROUP BY 1")
def agg_reason_buckets(spark, d):
    return _reasons(spark, d).groupBy(F.coalesce(F.split_part("reason", F.lit(":"), F.lit(1)), F.lit("kept")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""{FACTS}, v AS (SELECT f.*, l.quality FROM facts f LEFT JOIN labels l ON l.doc_id = f.episode_id)
SELECT count(*) AS total, count(*) FILTER (WHERE contiguous) AS rule_pass, count(*) FILTER (WHERE contiguous AND quality = 1) AS judge_pass,
  count(*) FILTER (WHERE contiguous AND quality = 0) AS judge_fail, count(*) FILTER (WHERE contiguous AND quality IS NULL) AS judge_error,
  round(100.0 * count(*) FILTER (WHERE contiguous AND quality = 1) / nullif(count(*), 0), 4) AS pass_pct FROM v""")
def agg_funnel(spark, d):
    v = _facts(spark, d).join(X.read(spark, d, "labels").withColumnRenamed("doc_id", "episode_id"), "episode_id", "left")
    ok = F.col("contiguous")
    passed = F.count_if(ok & (F.col("quality") == 1))
    return v.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("rule_pass"), passed.alias("judge_pass"), F.count_if(ok & (F.col("quality") == 0)).alias("judge_fail"),
        F.count_if(ok & F.col("quality").isNull()).alias("judge_error"), F.round(F.try_divide(passed * 100.0, F.count("*")), 4).alias("pass_pct"),
    )


@query(f"{W} SELECT episode_id, step, CASE WHEN rn > 1 AND rn < n AND n > 2 AND role = prev THEN false ELSE is_use END AS is_use FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY episode_id) AS n, lag(role) OVER w AS prev FROM steps WINDOW w AS (PARTITION BY episode_id ORDER BY step))")
def mark_duplicates(spark, d):
    s = X.steps(spark, d)
    same = F.col("role") == F.lag("role").over(Window.partitionBy("episode_id").orderBy("step"))
    return T.mark_repeats(s, same).select("episode_id", "step", "is_use")


@query(f"{W} SELECT episode_id, step FROM (SELECT *, max(step) FILTER (WHERE role <> 'assistant') OVER (PARTITION BY episode_id) AS last FROM steps) WHERE step <= last")
def prj_strip_trailing_assistant(spark, d):
    return T.without_trailing(X.steps(spark, d)).select("episode_id", "step")


@query(f"{W} SELECT episode_id, string_agg('**' || upper(substr(role, 1, 1)) || substr(role, 2) || '**: ' || action, chr(10) ORDER BY step) AS chat FROM steps WHERE role <> 'system' GROUP BY 1")
def prj_chat_text(spark, d):
    s = X.steps(spark, d).where("role <> 'system'")
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit("**: "), "action")
    turns = s.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("l")))).alias("t"))
    return turns.select("episode_id", F.array_join("t.l", "\n").alias("chat"))


RANK = "row_number() OVER (ORDER BY md5('42:' || episode_id), episode_id)"


@query(f"{W}, r AS (SELECT episode_id, {RANK} AS n FROM (SELECT DISTINCT episode_id FROM steps)) SELECT s.episode_id, s.step, CASE WHEN n <= 30 THEN 'test' ELSE 'train' END AS split FROM steps s JOIN r USING (episode_id)")
def split_traj_global(spark, d):
    return T.split_first(X.steps(spark, d), "episode_id", 30).select("episode_id", "step", "split")


@query(f"{W}, r AS (SELECT episode_id, row_number() OVER (PARTITION BY device ORDER BY md5('42:' || episode_id), episode_id) AS n FROM (SELECT DISTINCT episode_id, device FROM steps)) SELECT s.device, s.episode_id, s.step, CASE WHEN n <= 30 THEN 'test' ELSE 'train' END AS split FROM steps s JOIN r USING (episode_id)")
def split_traj_stratified(spark, d):
    return T.split_first(X.steps(spark, d), "episode_id", 30, strata=["device"]).select("device", "episode_id", "step", "split")


@query(f"{W} SELECT coalesce(CASE WHEN step % 4 = 0 THEN 'test' END, 'train') AS split, device, count(*) AS n FROM steps GROUP BY 1, 2")
def split_by_flag(spark, d):
    flag = F.when(F.col("step") % 4 == 0, "test")
    return X.steps(spark, d).groupBy(F.coalesce(flag, F.lit("train")).alias("split"), "device").agg(F.count("*").alias("n"))


@query(f"{W}, r AS (SELECT episode_id, {RANK} AS n, count(*) OVER () AS c FROM (SELECT DISTINCT episode_id FROM steps)) SELECT episode_id, n <= ceil(c * 0.1) AS is_test FROM r")
def split_fraction(spark, d):
    e = X.steps(spark, d).select("episode_id").distinct()
    n = -(-e.count() // 10)
    return T.split_first(e, "episode_id", n).select("episode_id", (F.col("split") == "test").alias("is_test"))


@query(f"{W}, s AS (SELECT *, CASE WHEN episode_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM steps) SELECT split, count(*) FILTER (WHERE device = 'mobile') AS mobile, count(*) FILTER (WHERE device = 'desktop') AS desktop FROM s GROUP BY 1")
def agg_split_source(spark, d):
    s = X.steps(spark, d).withColumn("split", F.when(F.col("episode_id") % 3 == 0, "test").otherwise("train"))
    return s.groupBy("split").pivot("device", ["mobile", "desktop"]).agg(F.count("step"))


@query(f"{W} SELECT device AS app, count(*) AS n FROM steps GROUP BY 1 ORDER BY n DESC")
def agg_app_steps(spark, d):
    return X.steps(spark, d).groupBy(F.col("device").alias("app")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_prompt(spark, d):
    """The first row of each prompt; the texts move once, under their digest."""
    docs = X.read(spark, d, "documents")
    keep = docs.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(keep, "doc_id", "left_semi").select("doc_id", "text")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, d):
    return latest(X.read(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT o_orderkey, 'task' || (o_custkey % 200) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_backup_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey END AS folder FROM orders),
b AS (SELECT *, regexp_replace(folder, '_backup_\\d+_\\d+$', '') AS base, nullif(regexp_extract(folder, '_backup_(\\d+_\\d+)$', 1), '') AS stamp FROM f)
SELECT base, folder FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY stamp DESC NULLS LAST, folder, o_orderkey) AS n FROM b) WHERE n = 1""")
def latest_backup(spark, d):
    o = X.read(spark, d, "orders")
    tail = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("_backup_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string")))
    f = o.select("o_orderkey", F.concat(F.lit("task"), (F.col("o_custkey") % 200).cast("string"), tail).alias("folder"))
    f = f.withColumn("base", F.regexp_replace("folder", r"_backup_\d+_\d+$", "")).withColumn("stamp", F.nullif(F.regexp_extract("folder", r"_backup_(\d+_\d+)$", 1), F.lit("")))
    return latest(f, ["base"], F.desc_nulls_last("stamp"), "folder", "o_orderkey").select("base", "folder")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE n_chars <= 3000")
def prj_index(spark, d):
    docs = X.read(spark, d, "documents").where("n_chars <= 3000").select("doc_id", "source")
    return numbered(docs, "doc_id", to="idx").select("doc_id", "source", "idx")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def sample_n(spark, d):
    return X.read(spark, d, "documents").select("doc_id").orderBy(seeded("doc_id"), "doc_id").limit(50)
