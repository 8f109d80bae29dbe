import hashlib
from collections import Counter

import numpy as np
import pytest

from tracewright.llm.line_dedup import LineCounts, PerfectHash, line_dedup

SCHEMA = "doc_id long, text string, n_lines string, _marks string, shard string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least, min_key):
    lines = [(t or "").split("\n") for _, t, _ in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    n = Counter(k for ls in lines for k in {key(x) for x in ls})
    out = []
    for (i, _, _), ls in zip(rows, lines):
        kept = [x for x in ls if not (len(key(x)) >= min_key and n[key(x)] >= least)]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bound", "min_key"), [(1 << 20, 1), (0, 3)])
def test_matches_plain_rules(spark, bound, min_key):
    common = ["Share this", "  share THIS\t", "ÀÉ", "é", "\x85", "a\rb", ""]
    rows = [(i, "\n".join([common[j] for j in range(7) if (i + j) % (j + 2) < 2] + [f"own {i}", f"own {i}"]), "x") for i in range(60)]
    rows += [(100, None, None), (101, "", None), (102, "Share this", None), (102, "Share this", None), (103, "share this\n" * 20000, None)]
    df = spark.createDataFrame([(*r, "m", "s") for r in rows], SCHEMA).repartition(5)
    out = line_dedup(df, min_docs=10, min_key=min_key, held_bytes=bound, shard_keys=2)
    assert out.columns == ["doc_id", "text", "_marks", "shard", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    out = out.collect()
    assert {(r._marks, r.shard) for r in out} == {("m", "s")}
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out], key=str) == plain(rows, 10, min_key)
    for r in out:
        assert (r.kept_text is None) == (r.doc_id == 100) and hashlib.sha256((r.kept_text or "").encode()).hexdigest() == r.kept_sha256


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_decide():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    n = rng.integers(2, 1000, 5000)
    made = LineCounts.of(a[:4000], b[:4000], n[:4000])
    assert (made.count(a, b) == np.concatenate([n[:4000], np.ones(1000, int)])).all()
    assert (LineCounts.of(a[:0], b[:0], n[:0]).count(a, b) == 1).all()


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50000):
        a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        a[: n // 3] = 7  # equal first halves are told apart by the second
        assert sorted(PerfectHash.of(a, b).places(a, b).tolist()) == list(range(n))
