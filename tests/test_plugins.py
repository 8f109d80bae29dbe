import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.functions import rewards
from tracewright.operators import dispatch
from tracewright.operators import metrics as M
from tracewright.operators.retrieval import nearest


@pytest.mark.parametrize(("n", "workers"), [(0, 3), (1, 4), (7, 3), (9, 3), (2, 7), (100, 8)])
def test_ranks_give_the_order_back(spark, n, workers):
    rows = [(i * 7 % 101, None if i == 3 else f"t{i}", "own") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, t string, rank string").repartition(4)
    seen = dispatch.to_ranks(df, "k", workers)
    sizes = Counter(r["rank"] for r in seen.collect())
    assert not n or len(sizes) == workers and len(set(sizes.values())) == 1

    def work(rank, frames):
        for at, frame in enumerate(frames):
            assert list(frame.columns) == ["k", "t"]
            yield pd.DataFrame({"k": frame.k, "t": frame.t})

    out = dispatch.dispatched(df, "k", workers, work, "k long, t string").orderBy("pos").collect()
    assert [(r.pos, r.k, r.t) for r in out] == [(p, k, t) for p, (k, t, _) in enumerate(sorted(rows))]


def test_ranks_that_do_not_divide(spark):
    with pytest.raises(ValueError, match="divide"):
        dispatch.to_ranks(spark.range(5), "id", 2, pad=False)
    assert dispatch.to_ranks(spark.range(6), "id", 2, pad=False).where("rank = 1").count() == 3
    assert dispatch.to_all(spark.range(3), 4).count() == 12


def test_custom_rewards(spark, tmp_path):
    (tmp_path / "r.py").write_text("import math\n\ndef plain(text, truth, scale=1):\n    return None if truth is None else scale * len(text or '')\n\nasync def slow(text, truth):\n    import asyncio\n    await asyncio.sleep(0)\n    return {'score': math.sqrt(len(text))}\n")
    df = spark.createDataFrame([("ab", "x"), (None, "x"), ("abcd", None)], "a string, b string").repartition(2)
    path = str(tmp_path / "r.py")
    score = rewards.custom_reward(spark, path, "plain", scale=3)
    assert sorted([r[0] for r in df.select(score("a", "b")).collect()], key=str) == [0.0, 6.0, None]
    wait = rewards.custom_reward(spark, path, "slow", together=2)
    assert [r[0] for r in df.where("a IS NOT NULL").select(wait("a", "b")).orderBy(F.length("a")).collect()] == [math.sqrt(2), 2.0]
    with pytest.raises(ValueError, match="no function nothing"):
        rewards.custom_reward(spark, path, "nothing")


def test_rewards_by_source(spark):
    @rewards.reward("one", "uno")
    def same(text, truth):
        return (text == truth).cast("int")

    try:
        df = spark.createDataFrame([("one", "a", "a"), ("uno", "a", "b"), ("two", "a", "a"), (None, "a", "a")], "s string, a string, b string")
        assert [r[0] for r in df.select(rewards.by_source(F.col("s"), F.col("a"), F.col("b"), -1.0)).collect()] == [1.0, 0.0, -1.0, -1.0]
    finally:
        rewards.REWARDS.clear()


def test_bootstrap_of_any_function(spark):
    rows = [(u, i, float(i * i % 7), i % 3) for u, n in ((1, 1), (2, 40), (3, 3000)) for i in range(n)]
    df = spark.createDataFrame(rows, "u long, i long, x double, p int").repartition(3)
    spread = lambda d: F.array_max(F.transform(d, lambda v: v["x"])) - F.array_min(F.transform(d, lambda v: v["x"]))
    out = {r.u: r for r in M.bootstrapped(df, "u", "i", ["x", "p"], 6, 60, {"spread": spread, "mean": M.average("x"), "maj": M.voted("p", "x")}).collect()}
    assert out[1].spread_mean == 0 and out[1].mean_std == 0 and out[1].maj_mean == 0
    for u in (2, 3):
        xs = [x for v, _, x, _ in rows if v == u]
        mean = sum(xs) / len(xs)
        sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs) / 6)
        assert abs(out[u].mean_mean - mean) < 5 * sd / math.sqrt(60) and 0.5 * sd < out[u].mean_std < 1.6 * sd
    assert M.bootstrapped(df.limit(0), "u", "i", ["x"], 2, 3, {"best": M.highest("x")}).collect() == []


def test_best_and_worst_with_ties_and_an_outlier(spark):
    xs = [0.0] * 50 + [1.0] * 30 + [1e9]
    df = spark.createDataFrame([(1, x) for x in xs] + [(1, None), (2, 5.0)], "u long, x double")
    got = {(r.u, r.n): (r.best, r.worst) for r in M.best_and_worst_of(df, "u", "x", [1, 2]).collect()}
    c, pairs = len(xs), [(a, b) for a in xs for b in xs]
    assert math.isclose(got[1, 1][0], sum(xs) / c) and got[2, 2] == (5.0, 5.0)
    assert math.isclose(got[1, 2][0], sum(map(max, pairs)) / c**2) and math.isclose(got[1, 2][1], sum(map(min, pairs)) / c**2)


def plain_bleu(h, r):
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (h, r))
        hit = sum(min(k, b[g]) for g, k in a.items())
        if not hit:
            return 0.0
        logs += math.log(hit / sum(a.values())) / 4
    return math.exp(logs) * (1 if len(h) > len(r) else math.exp(1 - len(r) / len(h)))


def test_bleu(spark):
    rng = random.Random(0)
    text = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(30)))
    rows = [(i, text(), text()) for i in range(60)] + [(60, "abcdef", "abcdef"), (61, None, "abcd"), (62, "abcd", None), (63, "", "")]
    got = {r.i: r.bleu for r in M.bleu(spark.createDataFrame(rows, "i long, h string, r string"), "i", "h", "r").collect()}
    assert len(got) == 64 and all(math.isclose(got[i], plain_bleu(h or "", r or ""), abs_tol=1e-12) for i, h, r in rows) and got[60] == 1


def test_bleu_shuffles_no_grams_and_knows_any_character(spark):
    rows = [(0, "a\0\0b\0\0\0", "\0\0\0b\0"), (1, "\0" * 6, "\0" * 5), (2, "\U0001f600éa\x01" * 3, "a\x01\U0001f600é" * 2)]
    out = M.bleu(spark.createDataFrame(rows, "i long, h string, r string"), "i", "h", "r")
    assert all(math.isclose(r.bleu, plain_bleu(*rows[r.i][1:]), abs_tol=1e-12) for r in out.collect())
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_with_ties_over_slices(spark):
    rng = random.Random(4)
    vectors = [(i, rng.choice([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [rng.random(), rng.random()]])) for i in range(3000)]
    df = spark.createDataFrame(vectors, "i long, v array<double>").repartition(2)
    got = {(r.query_id, r["rank"]): r.vec_id for r in nearest(df.where("i % 500 = 7"), df, 5, portion=1700).collect()}
    unit = lambda v: [x / max(v) / math.hypot(*[y / max(v) for y in v]) for x in v]
    for q in range(7, 3000, 500):
        a = unit(vectors[q][1])
        cos = lambda v: round(sum(x * y for x, y in zip(a, unit(v))), 12)
        near = [-cos(vectors[got[q, k]][1]) for k in range(1, 6)]
        want = sorted((-cos(v), i) for i, v in vectors if i != q)[:5]
        assert near == [s for s, _ in want] and len({got[q, k] for k in range(1, 6)}) == 5
