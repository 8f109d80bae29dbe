import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.components import connected_components, join_roots
from tracewright.llm.embedding_dedup import Block, close_pairs, embedding_dedup, unit

SCHEMA = "vec_id long, embedding array<double>, n_links string, weight string, b string, digest string"


def brute(rows, threshold=0.95):
    """One result for each row, by comparing all rows."""
    vecs = []
    for r in rows:
        ok = r[1] and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1])
        vecs.append(unit(np.array(r[1], float)[None])[0] if ok else None)
    near = [[j for j, y in enumerate(vecs) if j != i and x is not None and y is not None and len(x) == len(y) and (x * y).sum() >= threshold] for i, x in enumerate(vecs)]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k), todo.append(k)
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((r[0], len(near[i]), least, r[0] is not None and least == r[0]))
    return sorted(out, key=str)


def rows_of(n):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 8))
    return [(i, (base[i % 12] + rng.standard_normal(8) * rng.choice([0, 0.1, 0.25, 0.6])).tolist(), "x", None, None, None) for i in range(n)]


@pytest.mark.parametrize("block", [16, 65_536])
def test_matches_brute_force(spark, block):
    odd = [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] + [1.0] * 7), (205, [1.0, 2.0]), (206, [-0.0, 2.0]), (207, [0.0, 2.0])]
    # Without ids: a vector of its own, one that another row has, one near others; ids that repeat.
    odd += [(None, [9.0, -1.0, 0.5]), (None, [0.0, 2.0]), (None, rows_of(3)[2][1]), (None, None), (205, [1.0, 2.0]), (205, [-5.0, 1.0]), (None, [9.0, -1.0, 0.5])]
    rows = rows_of(120) + [(i, v, "x", None, None, None) for i, v in odd]
    got = embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_single_precision(spark):
    rows = [(r[0], np.array(r[1], np.float32).astype(float).tolist(), *r[2:]) for r in rows_of(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert sorted([tuple(r) for r in embedding_dedup(df).collect()], key=str) == brute(rows)


def test_empty_table(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tiles_lose_no_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((900, 16)), np.repeat(rng.standard_normal((300, 16)), 3, axis=0) + rng.standard_normal((900, 16)) * 0.2])
    block = Block.of(x)
    found = {(i, j) for a, b in close_pairs(block, block, 0.95, True) for i, j in zip(a.tolist(), b.tolist())}
    u = unit(x)
    a, b = np.nonzero(np.triu(np.einsum("ik,jk->ij", u, u), 1) >= 0.95)
    assert found == set(zip(a.tolist(), b.tolist())) and found
    one, two = Block.of(x[:1000]), Block.of(x[1000:])
    across = {(i, j + 1000) for p, q in close_pairs(one, two, 0.95, False) for i, j in zip(p.tolist(), q.tolist())}
    assert across == {(i, j) for i, j in found if i < 1000 <= j} and across


def test_roots_are_least_places():
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 400, (2, 250))
    root = np.arange(400)
    join_roots(root, i[:100], j[:100])
    join_roots(root, i[100:], j[100:])
    want = np.arange(400)
    for _ in range(400):
        low = np.minimum(want[i], want[j])
        np.minimum.at(want, i, low), np.minimum.at(want, j, low)
    assert (root == want).all()


@pytest.mark.parametrize(("hot", "each"), [(3, 4), (500, 20), (500, 1 << 20)])
def test_components_with_hot_nodes(spark, monkeypatch, hot, each):
    monkeypatch.setattr(common, "HOT", hot)
    edges = [(0, i) for i in range(5, 60)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 8), (130, 101), (90, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), each=each).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in [0, *range(5, 60), 90]} | {i: 100 for i in range(100, 131)}


def test_hot_class_and_hot_component(spark):
    """600 equal vectors, 600 different ones of one component, and 600 without a vector are spread, with equal results."""
    rng = np.random.default_rng(3)
    near = [(600 + i, (np.eye(8)[1] + 0.01 * rng.standard_normal(8)).tolist()) for i in range(600)]
    rows = [(i, np.eye(8)[0].tolist()) for i in range(600)] + near + [(1200 + i, None) for i in range(600)] + [(1800, np.eye(8)[2].tolist())]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (599, i // 600 * 600, i % 600 == 0) if i < 1200 else (0, i, True) for i, _ in rows}
