"""Queries over whole tables against brute force."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tracewright.operators import tokenwise as K
from tracewright.plans import registry
from tracewright.sources import files
from tracewright.sources import fixtures as X


def test_pack_greedy_gives_every_row_a_bin(spark, sf_dir):
    want = {}
    for r in X.rollouts(spark, sf_dir).orderBy("row_id").collect():
        bins = want.setdefault((r.row_id // 64, r.data_source), [0] * 4)
        bins[bins.index(min(bins))] += r.length
    got = registry.queries()["pack_greedy"](spark, sf_dir).collect()
    assert len(got) == len(want)
    assert {(r.block, r.data_source): r.bins for r in got} == {k: ",".join(map(str, v)) for k, v in want.items()}


def test_st_dynamic_dataset_takes_late_rows(spark, sf_dir, tmp_path):
    e = X.read(spark, sf_dir, "events")
    late = e.withColumns({"event_id": F.col("event_id") + 6000, "user_id": F.col("user_id") + 100000})
    e.union(late).write.parquet(str(tmp_path / "events.parquet"))
    want = {-i - 1 if i % 501 == 0 else u for i, u in e.union(late).select("event_id", "user_id").collect()}
    got = [r.uid for r in registry.queries()["st_dynamic_dataset"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_growing_table_is_filtered_batch_by_batch(spark, tmp_path):
    root = str(tmp_path / "t")
    for k in range(3):
        files.grow(spark.createDataFrame([(k * 2, 5), (k * 2 + 1, 9)], "uid int, length int"), root, 5)
    assert sorted(r.uid for r in spark.read.parquet(root).collect()) == [0, 2, 4]


def test_prj_mask_media_splits_whole_texts(spark, sf_dir, tmp_path):
    late = [(10**6 + i, "a" * 30 + "<image>" + "b" * 40 + "<video>") for i in range(3)]
    docs = X.read(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(late, "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, text in docs.where("length(text) > 0").collect():
        parts = [p for p in re.split("(<image>|<video>)", [f"<image>{text}<video>", text, f"{text}<image><image>"][i % 3]) if p]
        want[i] = ("|".join(p[1:-1] if p in ("<image>", "<video>") else "text" for p in parts), "".join(p for p in parts if p not in ("<image>", "<video>")))
    got = registry.queries()["prj_mask_media"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: (r.kinds, r.body) for r in got} == want


def test_join_prev_queries_lists_whole_queries(spark, sf_dir):
    want = {}
    for s in X.steps(spark, sf_dir).where("role = 'user'").orderBy("episode_id", "step").collect():
        want.setdefault(s.episode_id, []).append(s.action)
    got = registry.queries()["join_prev_queries"](spark, sf_dir).collect()
    assert {r.c_custkey: r.earlier for r in got} == {r.c_custkey: "|".join(want.get(r.c_custkey, [])) for r in X.read(spark, sf_dir, "customer").collect()}
    assert any(len(q) > 20 for r in got for q in r.earlier.split("|"))


def divergences(a, b, k, alpha):
    """Forward, backward, generalised Jensen-Shannon over the k most likely of ``a`` and the tail, and the entropy of ``a``."""
    p, q = ([math.exp(v) / sum(map(math.exp, x)) for v in x] for x in (a, b))
    top = sorted(range(len(p)), key=lambda i: (-p[i], i))[:k]
    s, t = ([x[i] for i in top] + [max(1 - sum(x[i] for i in top), 1e-7)] for x in (p, q))
    mix = [alpha * u + (1 - alpha) * v for u, v in zip(s, t)]
    kl = lambda x, y: sum(u * math.log(u / v) for u, v in zip(x, y))
    return kl(s, t), kl(t, s), alpha * kl(s, mix) + (1 - alpha) * kl(t, mix), -sum(u * math.log(u) for u in p)


def test_topk_divergence_chooses_and_has_a_tail(spark, sf_dir):
    want = {r.id: divergences(r.a, r.b, 8, 0.5) for r in X.token_pairs(spark, sf_dir).collect()}
    got = registry.queries()["topk_divergence"](spark, sf_dir).collect()
    assert len(got) == len(want)
    assert all(abs(u - v) < 2e-5 for r in got for u, v in zip((r.forward, r.backward, r.jensen, r.entropy), want[r.id]))


def test_divergence_of_unequal_shares(spark):
    a, b = [0.0, 3.0, -1.0, 2.0, 3.0], [1.0, 0.0, 2.0, -3.0, 0.5]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(K.log_softmax("a").alias("a"), K.log_softmax("b").alias("b"))
    df = df.withColumn("top", K.most_likely("a", 3)).select("top", K.with_tail("a", "top").alias("a"), K.with_tail("b", "top").alias("b"))
    r = df.select("top", *[K.divergence("a", "b", x) for x in (0.0, 1.0, 0.3)]).first()
    assert r[0] == [1, 4, 3] and all(abs(u - v) < 1e-9 for u, v in zip(r[1:], divergences(a, b, 3, 0.3)))


@pytest.mark.parametrize("name", ["win_last3_passrate", "st_replay_ratio", "st_bounded_queue"])
def test_newest_rows_are_limited_before_the_shuffle(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "WindowGroupLimit" in plan and "Partial" in plan


def test_a_nation_has_one_list(spark, sf_dir):
    from tracewright.plans import registry

    got = registry.queries()["list_dict_transpose"](spark, sf_dir).collect()
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert len(got) == keys.select("c_nationkey").distinct().count() and sum(len(r["keys"].split(",")) for r in got) == keys.count()
