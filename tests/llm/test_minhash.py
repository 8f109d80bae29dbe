import random

import pytest

from tracewright.llm import common
from tracewright.llm.minhash import near_duplicates, without_near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, cid string, n string, rid string, key string"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} if w else ())


def brute(rows, k, percent):
    """For each row in order: id, size, component, kept; rows with words that share an id are one document."""
    sets = [shingles(t, k) for _, t, *_ in rows]
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    near = [[j for j, b in enumerate(sets) if j != i and a and b and (like(a, b) or rows[i][0] is not None and rows[i][0] == rows[j][0])] for i, a in enumerate(sets)]
    out = []
    for i, (ident, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((ident, len(sets[i]), least, ident is not None and ident == least))
    return out


def rows_of(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([2, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "ÀB c"), (n + 4, "àb c"), (n + 5, "a b c " * 3000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, None, "y", None) for r in rows], SCHEMA)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 85, True), (5, 80, False)])
def test_matches_brute_force(spark, monkeypatch, k, percent, small):
    if small:
        monkeypatch.setattr(common, "HOT", 3)
    rows = rows_of(k)
    options = {"tile_rows": 3, "broadcast_ids": 0} if small else {}
    df = table(spark, rows)
    want = brute(rows, k, percent)
    assert found(near_duplicates(df, k, percent, **options)) == sorted(want, key=str)
    kept = without_near_duplicates(df, k, percent, **options)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, n, _, stays in want if stays]


def test_a_group_of_near_copies_that_no_leader_holds(spark):
    """A chain of texts, each near the next, in crowded buckets: only tiles can join it."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = list(base)
        base[rng.randrange(300)] = f"n{i}"
        rows.append((100 - i, " ".join(base)))
    assert len({c for _, _, c, _ in brute(rows, 3, 85)}) < 5
    assert found(near_duplicates(table(spark, rows), 3, 85, tile_rows=7)) == sorted(brute(rows, 3, 85), key=str)


def test_empty_table(spark):
    df = table(spark, [])
    assert near_duplicates(df).collect() == [] and without_near_duplicates(df).collect() == []


def test_ids_that_repeat_or_are_missing(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "and some more words of another text")
    rows = [(5, a), (5, b), (3, b), (9, a), (None, c), (None, c), (None, a), (5, ""), (7, c + " x y z"), (7, None), (4, "q"), (4, "q")]
    got = found(near_duplicates(table(spark, rows)))
    assert got == sorted(brute(rows, 5, 80), key=str)
    assert {r[2] for r in got if r[0] in (5, 9) and r[1]} == {3} and (None, 3, None, False) in got
    # By text: of (5, b) and (3, b) one stays, of (5, a), (9, a) and (None, a) one, of equal rows one.
    kept = without_near_duplicates(table(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, a), (3, b), (None, c), (5, ""), (7, c + " x y z"), (7, None), (4, "q")], key=str)
