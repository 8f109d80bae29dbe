import random
import zlib

import numpy as np
import pytest

from tracewright.llm.periodic_runs import Suffixes, batch_runs, next_smaller, periodic_runs, with_periodic_tails

SCHEMA = "doc_id long, text string, runs string, `a.b` string, N_words string"


def plain(w, least, exponent):
    """All runs, by comparing words period by period; of one stretch the smallest period."""
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q and (s, i) not in seen and not any(a <= s and i + q <= a + n and q % p == 0 for a, n, p in out):
                seen.add((s, i))
                out.append((s, i + q - s, q))
    return sorted((r for r in out if r[1] >= max(least, exponent * r[2])), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "exponent"), [(2, 2), (6, 4), (1, 3), (5, 2.5)])
def test_batches_match_plain_rules(least, exponent):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(6)):
            d = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(40))]
            docs.append(np.array((d[: rng.randrange(1, 6)] * 20)[: len(d)] if rng.random() < 0.4 else d, np.int64))
        for d, found in zip(docs, batch_runs(docs, least, exponent)):
            assert [tuple(x) for x in found.tolist()] == plain(d.tolist(), least, exponent)


def test_suffixes_and_next_values():
    rng = random.Random(0)
    for _ in range(50):
        s = np.array([rng.randrange(1, 3) for _ in range(rng.randrange(2, 40))] + [0], np.int64)
        made, n = Suffixes(s), len(s)
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        assert made.places.tolist() == order
        same = lambda i, j: next(k for k in range(n) if s[i + k] != s[j + k])
        i, j = np.array([(a, b) for a in range(n) for b in range(n) if a != b]).T
        assert made.common(i, j).tolist() == [same(a, b) for a, b in zip(i.tolist(), j.tolist())]
        rank = made.rank.tolist()
        less, more = next_smaller(made.rank)
        assert less.tolist() == [next((k for k in range(i + 1, n) if rank[k] < rank[i]), n) for i in range(n)]
        assert more.tolist() == [next((k for k in range(i + 1, n) if rank[k] > rank[i]), n) for i in range(n)]


def test_rows_of_any_kind(spark):
    rows = [(1, "a b a b a b a b x", "r", "d", "n"), (1, "a b a b a b a b x", "r", "d", "n"), (None, "z\tz\nz z z z", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (4, " \n", None, None, None)]
    rows += [(5, "é É " * 9, None, None, None), (6, "w " * 200_000, None, None, None), (7, "x" * 300_000, None, None, None)]
    out = periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), min_length=6, min_exponent=4).collect()
    got = sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text[:20]) for r in out], key=str)
    want = [(1, 9, [(0, 8, 2)], "a b x")] * 2 + [(None, 6, [(0, 6, 1)], "z"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 18, [(0, 18, 2)], "é É"), (6, 200_000, [(0, 200_000, 1)], "w"), (7, 1, [], "x" * 20)]
    assert got == sorted(want, key=str)


def test_tails(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37)) + (" \n" if i % 2 else ""), None, None, None) for i in range(300)] + [(None, "a b c d e f", None, None, None), (999, None, None, None, None)]
    changed = 0
    for r in with_periodic_tails(spark.createDataFrame(rows, SCHEMA)).collect():
        text = dict((x[0], x[1]) for x in rows)[r.doc_id] if r.text is not None else None
        h = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        w, g = (text or "").split(), h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))
            changed += 1
        assert r.text == text
    assert changed > 10


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert periodic_runs(with_periodic_tails(none)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(none, min_exponent=1)
