"""A dataset that generates rows from its own, as a Spark data source.

``register_dataset`` makes a format of a function that generates rows: ``spark.read.format(name)`` reads a table's rows
(step 0) and those that each step generates from them; ``spark.readStream`` gives step after step, with the step as its
offset, so that a stream goes on where it stopped. Partitions are row groups times steps, read and generated in tasks;
filters prune steps and row groups before anything is generated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

Generate = Callable[[pa.Table, int], pa.Table]
STEP = "step"


@dataclass
class Share(InputPartition):
    """Row groups of a file, at one step."""

    uri: str
    groups: list[int]
    step: int

    def __hash__(self) -> int:
        return hash((self.uri, tuple(self.groups), self.step))


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(_uri(path))
    return ds.dataset(at, filesystem=store, format="parquet")


def _uri(path: str) -> str:
    return path if urlsplit(path).scheme else f"file://{path}"


def _shares(path: str, steps: range, condition) -> list[Share]:
    """The row groups that may hold rows of step 0 under ``condition``, and all row groups for each later step."""
    scheme, out = _uri(path).split("://", 1)[0], []
    for step in steps:
        for whole in _dataset(path).get_fragments():
            for group in whole.split_by_row_group(condition if step == 0 else None):
                out.append(Share(f"{scheme}://{whole.path}", [g.id for g in group.row_groups], step))
    return out


#: Rows of a row group that a task reads, and generates from, at a time.
MOST_ROWS = 65_536

#: Comparisons that Arrow makes as Spark would.
COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def _expression(f: Filter):
    """The filter for Arrow, on a column of its own; null if it is none that Arrow takes."""
    import pyarrow.compute as pc

    if len(f.attribute) != 1:
        return None
    column = pc.field(f.attribute[0])
    if isinstance(f, IsNotNull):
        return column.is_valid()
    # Arrow orders NaN unlike Spark, so numbers with a fraction stay with Spark.
    plain = lambda v: isinstance(v, (int, str)) and not isinstance(v, bool)
    if isinstance(f, In):
        return column.isin(list(f.value)) if all(map(plain, f.value)) else None
    for kind, compare in COMPARED.items():
        if type(f) is kind and plain(f.value):
            return compare(column, f.value)
    return None


def _holds(f: Filter, step: int) -> bool:
    if isinstance(f, In):
        return step in f.value
    return isinstance(f, IsNotNull) or COMPARED[type(f)](step, f.value)


def _read(share: Share, schema: pa.Schema, generate: Generate, condition) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(share.uri)
    with store.open_input_file(at) as source:
        names = [n for n in schema.names if n != STEP]
        file = pq.ParquetFile(source, buffer_size=1 << 20)
        for batch in file.iter_batches(MOST_ROWS, row_groups=share.groups, columns=names if share.step == 0 else None):
            rows = pa.Table.from_batches([batch])
            if share.step:
                rows = generate(rows, share.step)
            rows = rows.select(names).append_column(STEP, pa.repeat(pa.scalar(share.step, pa.int32()), rows.num_rows))
            rows = rows.select(schema.names).cast(schema)
            yield from (rows.filter(condition) if condition is not None else rows).to_batches(max_chunksize=10_000)


class _Reader(DataSourceReader):
    def __init__(self, path: str, steps: int, schema: StructType, generate: Generate) -> None:
        self.path, self.steps, self.schema, self.generate, self.condition = path, range(steps + 1), to_arrow_schema(schema), generate, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == (STEP,) and (isinstance(f, (In, IsNotNull)) or type(f) in COMPARED):
                self.steps = [s for s in self.steps if _holds(f, s)]
                continue
            one = _expression(f)
            if one is None:
                yield f
            else:
                self.condition = one if self.condition is None else self.condition & one

    def partitions(self) -> list[Share]:
        return _shares(self.path, self.steps, self.condition) or [Share("", [], 0)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if share.uri:
            yield from _read(share, self.schema, self.generate, self.condition)


class _StreamReader(DataSourceStreamReader):
    """An offset is the number of steps that are done; a batch has the steps since, a restart those after the last."""

    def __init__(self, path: str, steps: int, schema: StructType, generate: Generate) -> None:
        self.path, self.steps, self.schema, self.generate = path, steps, to_arrow_schema(schema), generate

    def initialOffset(self) -> dict:
        return {"done": 0}

    def latestOffset(self) -> dict:
        return {"done": self.steps + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return _shares(self.path, range(start["done"], end["done"]), None)

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        yield from _read(share, self.schema, self.generate, None)


def register_dataset(spark: SparkSession, name: str, generate: Generate) -> None:
    """A format of this name, read with the options ``path`` (Parquet) and ``steps`` (0 if left out).

    ``generate(rows, step)`` gives an Arrow table with the columns of the rows it gets, at most ``MOST_ROWS`` of one row
    group, for steps 1 and on; it runs in tasks, again if a task is lost, so the same rows and step must give the same. Rows have the columns of the
    table, less one named ``step``, and ``step``; filters on ``step`` and comparisons of columns with whole numbers and
    texts are made where rows are read, others by Spark (the
    session's filter pushdown to Python sources is turned on). An empty table gives no rows.
    """

    class Dataset(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            fields = from_arrow_schema(_dataset(self.options["path"]).schema).fields
            return StructType([f for f in fields if f.name != STEP]).add(STEP, IntegerType())

        def _arguments(self, schema: StructType) -> tuple:
            return self.options["path"], int(self.options.get("steps", 0)), schema, generate

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(*self._arguments(schema))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _StreamReader(*self._arguments(schema))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Dataset)
