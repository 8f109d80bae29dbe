import hashlib
import random

import numpy as np
import pytest

from tracewright.llm.substring_dedup import run_hashes, sliding_min, substring_dedup, super_kmers

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, window):
    first = {}
    big = 1 << 63
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÀé") for _ in range(5))
    passages = [[word() for _ in range(rng.choice([9, 10, 11, 30, 80]))] for _ in range(8)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(12))] + (passages[0] if rng.random() < 0.4 else rng.choice(passages))
        if rng.random() < 0.3 and w:
            k = rng.randrange(len(w))
            w = w[:k] + ["same"] * 40 + w[k:]
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(w), "x"))
    rng.shuffle(rows)
    return rows + [(100, None, None), (101, "", None), (None, rows[0][1], None), (3, rows[1][1], None), (3, "x y", None), (102, "same " * 3000, None), (5, "same " * 20, None)]


@pytest.mark.parametrize(("keys", "hot"), [(10**6, 10**6), (0, 3)])
def test_matches_brute_force(spark, keys, hot):
    rows = rows_of(hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = substring_dedup(df, window=10, gram=3, broadcast_keys=keys, hot=hot).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out], key=str) == brute(rows, 10)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_greatest_id_comes_back(spark):
    rows = [((1 << 63) - 1, "a b c d e f", "x"), (None, "a b c d e f", None), (4, "z a b c d e", None)]
    out = substring_dedup(spark.createDataFrame(rows, SCHEMA), window=4, gram=2).collect()
    assert sorted([(r.doc_id, r.n_removed) for r in out], key=str) == [(4, 0), ((1 << 63) - 1, 5), (None, 5)]


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_are_all_in_one_super_kmer():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 5, 3000).astype(np.uint64)
    m, start, windows = super_kmers(h, 20, 4, longest=7)
    assert start[0] == 0 and (start[1:] == start[:-1] + windows[:-1]).all() and start[-1] + windows[-1] == 3000 - 19 and windows.max() <= 7
    grams = run_hashes(h, 4)
    assert all(grams[i : i + 17].min() == np.uint64(x & (2**64 - 1)) for s, n, x in zip(start.tolist(), windows.tolist(), m.tolist()) for i in range(s, s + n))
    same = {}
    for i in range(len(grams)):
        assert same.setdefault(tuple(h[i : i + 4]), grams[i]) == grams[i]
    assert len(set(same.values())) == len(same)
    assert all((sliding_min(h, k) == [h[i : i + k].min() for i in range(3001 - k)]).all() for k in range(1, 40))
