"""Plans of the native operators: no Python, pruned columns, pushed filters, early combining."""

import pytest

from tracewright.plans import registry

PYTHON = {"dispatch_ranks", "score_custom", "fn_math_equal", "score_prime_math", "fn_tool_calls", "fn_tool_calls_channels", "fn_python_text", "pack_karmarkar_karp", "balance_batch", "score_math", "retrieve_topk", "st_replay_sampler", "st_thought_buffer_stream", "st_rate_limit", "st_filter_sampler"}
STREAMS = {"scan_generated_dataset", "st_generated_dataset", "st_restart", "scan_task_json", "scan_jsonl_lenient", "scan_rollout_dumps", "scan_annotations", "scan_csv_tasks", "scan_two_level", "scan_traj_json", "scan_result_score", "scan_screenshots", "scan_app_definitions", "scan_jsonl_strict", "checkpoint_state", "st_dynamic_dataset", "st_tumbling", "st_sliding", "st_sessions", "st_group_accumulate", "sink_metrics", "sink_parquet"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - PYTHON - STREAMS))
def test_no_python_or_cartesian(spark, sf_dir, name):
    p = plan(registry.queries()[name](spark, sf_dir))
    assert not any(x in p for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct"))


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    q = registry.queries()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plan(q["flt_date_range"](spark, sf_dir))
    p = plan(q["flt_equals"](spark, sf_dir))
    assert "EqualTo(o_orderstatus,F)" in p and "o_totalprice" not in p
    assert "text" not in plan(q["anti_cache"](spark, sf_dir))
    assert "partial_" in plan(q["agg_group_uitype"](spark, sf_dir)) and "TakeOrderedAndProject" in plan(q["topk_rows"](spark, sf_dir))


def test_pairs_of_one_bucket_are_dealt_to_tasks(spark):
    from pyspark.sql import functions as F

    from tracewright.operators.joins import range_join

    points, spans = spark.range(0, 400, 1, 1).selectExpr("id", "id / 1000 AS x"), spark.range(0, 5, 1, 1).selectExpr("id AS s", "double(0) AS low", "double(1) AS high")
    pairs = range_join(points, spans, "x", "low", "high", 5)
    assert pairs.distinct().count() == pairs.count() == 2000
    assert pairs.select(F.spark_partition_id()).distinct().count() > 4


def test_texts_are_parsed_once_for_share_and_score(spark, sf_dir):
    q = registry.queries()
    parses = lambda name: q[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
    # A table's responses and labels; responses alone where the label is a constant.
    assert parses("rw_rules") == 2 and parses("score_gui") == parses("score_gui_planb") == 1


def test_parsed_calls_score_as_their_texts(spark, sf_dir):
    from pyspark.sql import functions as F

    from tracewright.functions import scoring as S
    from tracewright.functions import text as T
    from tracewright.plans.scores import _ruled

    c = _ruled(spark, sf_dir).withColumn("p", T.tool_call(F.col("response"))).withColumn("q", T.tool_call(F.col("truth")))
    box = F.col("box")
    got = c.select(S.call_score(F.col("p"), F.col("q"), box, box).alias("x"), S.gui_score(F.col("response"), F.col("truth"), box, box).alias("y")).groupBy("x", "y").count().collect()
    assert {r["x"] for r in got} == {1.0, -0.5, -1.0} and all(r["x"] == r["y"] for r in got)


def test_texts_are_dealt_to_tasks_before_python(spark, sf_dir):
    assert "hashpartitioning(p_partkey" in plan(registry.queries()["fn_python_text"](spark, sf_dir))
