import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewright.sources.dataset import register_dataset
from tracewright.streaming import stateful as S
from tracewright.streaming.place import shared_dir


def register(spark):
    def doubled(rows, step):  # a function of a function goes to tasks as it is
        at = rows.schema.get_field_index("x")
        return rows.filter(pc.is_valid(rows.column("x"))).set_column(at, "x", pc.multiply(rows.column("x").drop_null(), step + 1))

    register_dataset(spark, "doubled", doubled)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [{"i": i, "x": None if i % 7 == 3 else i * 10, "step": "own", "t": f"t{i % 3}", "f": float("nan") if i == 5 else i / 2} for i in range(40)]
    for k in range(2):
        pq.write_table(pa.Table.from_pylist(rows[k * 20 : k * 20 + 20]), tmp_path / f"{k}.parquet", row_group_size=6)
    register(spark)
    own = [(r["i"], r["x"], 0) for r in rows]
    return str(tmp_path), own + [(i, x * (s + 1), s) for s in (1, 2) for i, x, _ in own if x is not None]


def load(spark, path, steps=2):
    return spark.read.format("doubled").option("path", path).option("steps", steps).load()


def rows(df):
    return sorted([(r.i, r.x, r.step) for r in df.select("i", "x", "step").collect()], key=str)


def test_all_rows_and_columns(spark, folder):
    path, want = folder
    df = load(spark, path)
    assert df.columns == ["i", "x", "t", "f", "step"] and rows(df) == sorted(want, key=str)
    assert rows(load(spark, path, 0)) == sorted([w for w in want if w[2] == 0], key=str)
    assert df.select("t").distinct().count() == 3


@pytest.mark.parametrize(
    ("condition", "holds", "partitions"),
    [("step = 1", lambda i, x, s: s == 1, 8), ("step > 0 AND x >= 100", lambda i, x, s: s > 0 and x >= 100, 16), ("i IN (1, 39) AND step = 0", lambda i, x, s: i in (1, 39) and s == 0, 2), ("x IS NULL", lambda i, x, s: x is None, 24), ("t = 't1' AND i < 6", lambda i, x, s: i % 3 == 1 and i < 6, 17), ("step = 9", lambda i, x, s: False, 1), ("f > 15 AND step = 2", lambda i, x, s: s == 2 and (i > 30 or i == 5), 8)],
)
def test_filters(spark, folder, condition, holds, partitions):
    path, want = folder
    df = load(spark, path).where(condition)
    assert rows(df) == sorted([w for w in want if holds(*w)], key=str)
    # Steps and row groups that can't hold a row are not read.
    assert df.rdd.getNumPartitions() == partitions


def test_stream_goes_on_after_a_restart_and_a_cut(spark, folder):
    path, want = folder
    root = shared_dir(spark)
    at = lambda steps: spark.readStream.format("doubled").option("path", path).option("steps", steps).load().select("i", "x", "step")
    S.run(at(0), root, "append")
    with pytest.raises(Exception, match="1"):
        S.run(at(1), root, "append", fail_at=1)
    S.run(at(1), root, "append")
    S.run(at(2), root, "append")
    S.run(at(2), root, "append")
    out = spark.read.schema("i long, x long, step int, batch long").option("basePath", f"{root}/out").parquet(f"{root}/out")
    assert rows(out) == sorted(want, key=str) and out.select(F.max("batch")).first()[0] == 2


def test_empty_table(spark, tmp_path):
    pq.write_table(pa.table({"i": pa.array([], pa.int64()), "x": pa.array([], pa.int64())}), tmp_path / "0.parquet")
    register(spark)
    assert rows(load(spark, str(tmp_path))) == []


def test_a_row_group_is_read_in_parts(tmp_path, monkeypatch):
    from tracewright.sources import dataset

    pq.write_table(pa.table({"i": range(10)}), tmp_path / "0.parquet")
    monkeypatch.setattr(dataset, "MOST_ROWS", 4, raising=False)
    sizes = []
    generate = lambda rows, step: sizes.append(rows.num_rows) or rows
    share = dataset.Share(f"file://{tmp_path}/0.parquet", [0], 1)
    got = [x for b in dataset._read(share, pa.schema([("i", pa.int64()), ("step", pa.int32())]), generate, None) for x in b.column(0).to_pylist()]
    assert got == list(range(10)) and sizes == [4, 4, 2]
