from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators.packing import differenced, karmarkar_karp

WEIGHTS = st.lists(st.integers(0, 50), min_size=1, max_size=7)


@settings(max_examples=60, deadline=None)
@given(WEIGHTS, st.integers(2, 3))
def test_parts_hold_all_and_are_near_the_best(weights, parts):
    got = differenced(weights, parts, False)
    assert sorted(i for p in got for i in p) == list(range(len(weights))) and len(got) == parts
    loads = [sum(weights[i] for i in p) for p in got]
    best = min(max(sum(w for w, k in zip(weights, c) if k == b) for b in range(parts)) for c in product(range(parts), repeat=len(weights)))
    assert best <= max(loads) <= best * 4 / 3 + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=4, max_size=40).filter(lambda w: len(w) % 4 == 0))
def test_equal_parts_have_equal_sizes(weights):
    got = differenced(weights, 4, True)
    assert {len(p) for p in got} == {len(weights) // 4} and sorted(i for p in got for i in p) == list(range(len(weights)))


def test_rows(spark):
    df = spark.createDataFrame([(i // 10, i, i * 7 % 13 + 1) for i in range(40)], "g int, row long, w int")
    out = karmarkar_karp(df, "g", "w", "row", 3).collect()
    assert sorted(r.row for r in out) == list(range(40)) and {r.bin for r in out} == {0, 1, 2}
