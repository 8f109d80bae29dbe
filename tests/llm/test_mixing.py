import pytest
from pyspark.sql import functions as F

from tracewright.llm.mixing import mixed, text_quality, word_count

SCHEMA = "doc_id long, text string, source string, target string"


def water(sizes):
    """Targets by sharing the excess again until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level >= 3 * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("n", [0, 1, 400])
def test_targets_epochs_and_reruns(spark, n):
    rows = [(i, " ".join("w" for _ in range(i * 7 % 23)) if i % 50 else None, [None, "a", "b", "b", "c", "é"][i % 6] if i % 40 else "tiny", None) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda: {r.doc_id: r for r in mixed(df, word_count("text"), quality=text_quality("text")).collect()}
    out = run()
    assert len(out) == n and {k: r.taken for k, r in run().items()} == {k: r.taken for k, r in out.items()}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = water(sizes)
    for s, size in sizes.items():
        mine = [r for r in out.values() if r.source == s]
        assert {r.source_size for r in mine} == {size}
        assert mine[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= 22 / 2 + 1e-6
        assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in mine)
        epochs = int(want[s] // size) if size else 0
        assert all(r.taken >= epochs * r.size for r in mine)


@pytest.mark.parametrize(("cells", "ordered"), [(2, 1), (3, 5), (1024, 1)])
def test_narrowing_gives_the_same_mix(spark, cells, ordered):
    rows = [(i % 300, " ".join("w" for _ in range(i * 7 % 23)), [None, "a", "b"][i % 3], None) for i in range(900)]
    rows += [(None, "no id " * (i % 4), "a", None) for i in range(60)] + [(i, "!" * 60 + " w", "b", None) for i in range(2000, 2060)] + [(3000, "long " * 50_000, "c", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    take = lambda **options: sorted([tuple(r) for r in mixed(df, word_count("text"), quality=text_quality("text"), **options).select("doc_id", "source", "size", "taken", "target").collect()], key=str)
    assert take(cells=cells, ordered=ordered) == take()


def test_any_column_names(spark):
    names = ["cut", "_key", "_ident", "_range", "_last", "_source", "key", "ident", "low", "rest", "c0", "a", "taken"]
    df = spark.createDataFrame([(i, "w " * i, f"s{i % 2}", *range(len(names))) for i in range(1, 40)], ["doc_id", "text", "source", *names])
    out = mixed(df, word_count("text"))
    assert out.columns == ["doc_id", "text", "source", *names[:-1], "size", "source_size", "target", "epochs", "taken"]
    assert all(r.text == "w " * r.doc_id and tuple(r)[3:15] == tuple(range(12)) for r in out.collect())
    assert sorted(r.taken for r in out.collect()) == sorted(r.taken for r in mixed(df.select("doc_id", "text", "source"), word_count("text")).collect())


def test_heavier_quality_is_taken_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), (F.col("id") % 2 + 0.1).alias("q"))
    out = mixed(df, word_count("text"), quality=F.col("q")).where("source = 'b'").groupBy((F.col("q") > 1).alias("good")).agg(F.sum("taken").alias("n")).collect()
    n = {r.good: r.n for r in out}
    assert n[True] > 2 * n[False]


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "a b", "s", None)] * 6 + [(None, "a", "s", None), (3, "", "t", None)], SCHEMA)
    out = mixed(df, word_count("text")).collect()
    assert len(out) == 8 and all(r.taken <= 3 * r.size for r in out)


def test_rows_of_one_id_and_of_none_meet_the_target(spark):
    rows = [(7, f"{i} " + "w " * (4 + i % 3), "a", None) for i in range(60)] + [(None, f"{i} " + "w " * 9, "b", None) for i in range(40)]
    rows += [(None, "same of all " * 3, "c", None)] * 30 + [(5, "one " * 11, "c", None)]
    out = mixed(spark.createDataFrame(rows, SCHEMA), word_count("text"), tie=F.md5("text")).collect()
    for source, most in (("a", 8), ("b", 10), ("c", 9 * 30)):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= most / 2 and all(r.taken <= 3 * r.size for r in mine)


def test_names_with_dots_and_other_case(spark):
    df = spark.createDataFrame([(i, "w " * i, "s", i, i) for i in range(1, 30)], "doc_id long, `my.text` string, source string, Size int, `a.b``c` int")
    out = mixed(df, F.size(F.split("`my.text`", " ")) - 1)
    assert out.columns == ["doc_id", "my.text", "source", "a.b`c", "size", "source_size", "target", "epochs", "taken"] and out.count() == 29
