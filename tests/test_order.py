import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators.batch import resampled
from tracewright.operators.order import numbered, numbered_by_hash, ranked, running, seeded
from tracewright.operators.retrieval import nearest


@pytest.mark.parametrize("each", [7, 50, 100_000])
def test_positions(spark, each):
    # A third of all rows share a key; nulls, NaN-free doubles and ties.
    rows = [(i, 5.0 if i % 3 == 0 else None if i % 50 == 1 else float(i * 37 % 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(5)
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0])))}
    assert {r.id: r.pos for r in numbered(df, "v", "id", each=each).collect()} == want
    assert numbered(df, "v", "id", each=each).columns == ["id", "v", "pos"]
    assert numbered(df.limit(0), "v").collect() == []
    hashed = numbered_by_hash(df.withColumn("h", seeded("id", seed=3)), "h", "id", each=each).collect()
    assert [r.id for r in sorted(hashed, key=lambda r: r.pos)] == [r.id for r in sorted(hashed, key=lambda r: (r.h, r.id))]


def test_ranks_within_a_key(spark):
    rows = [(i, "hot" if i % 3 else "b", i * 7 % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = ranked(df, "g", ["v", "id"], {"_a": F.col("v"), "_b": F.floor(F.col("id") / 10)})
    want = {}
    for g in ("hot", "b"):
        for k, (i, *_) in enumerate(sorted([r for r in rows if r[1] == g], key=lambda r: (r[2], r[0]))):
            want[i] = k
    assert got.columns == ["id", "g", "v", "pos"] and {r.id: r.pos for r in got.collect()} == want


def test_sums_within_a_key(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 3 else "b", None if i % 11 == 0 else float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(4)
    want, total = {}, {}
    for i, g, v in rows:
        want[i] = total[g] = total.get(g, 0.0) + (v or 0.0)
    ranges = {"_a": F.floor(F.col("id") / 16)}
    got = running(df, "g", "v", ["id"], ranges)
    assert got.columns == ["id", "g", "v", "sum"] and {r.id: r.sum for r in got.collect()} == want
    assert running(df.limit(0), "g", "v", ["id"], ranges).collect() == []
    assert sorted(r.pos for r in ranked(df.where("g is null"), "g", ["id"], ranges).collect()) == list(range(60))


def test_heavier_rows_are_drawn_more_often(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).cast("double").alias("w"))
    out = resampled(df, "w", "id").groupBy("w").count().collect()
    n = {r.w: r["count"] for r in out}
    assert sum(n.values()) == 3000 and n.get(0.0, 0) == 0 and 1.8 < n[2.0] / n[1.0] < 2.2
    assert resampled(df.limit(0), "w", "id").collect() == []


@pytest.mark.parametrize(("block", "portion"), [(3, 11), (2048, 65_536)])
def test_nearest_in_blocks(spark, block, portion):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(80)] + [(100 + i, rows_) for i, rows_ in enumerate([None, [], [0.0] * 6, [float("nan")] * 6, [None] + [1.0] * 5, [1.0, 2.0], [2.0, 1.0]])] + [(None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = df.where("id % 10 = 0 or id >= 100")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(asked, df, 3, block, portion).collect())
    valid = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    want = []
    for q in [i for i in valid if i % 10 == 0 or i >= 100]:
        cos = lambda i: valid[i] @ valid[q] / np.linalg.norm(valid[i]) / np.linalg.norm(valid[q])
        near = sorted([i for i in valid if i != q and len(valid[i]) == len(valid[q])], key=lambda i: (-round(cos(i), 12), i))[:3]
        want += [(q, k, i) for k, i in enumerate(near, 1)]
    assert got == sorted(want)
