"""Shared folder, table and cleaning helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words and is stripped from lines (a fixed value of the contracts).
SPACE = b" \t\n\x0b\x0c\r"
#: The same as a Java regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where it must be set; under a local master without it a folder
    of this machine is used and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not top:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/tracewright-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def opened(uri: str):
    """File system and path of a shared folder's file; both local and remote stores work."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends there and nothing runs twice."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: The most rows that ``join_totals`` broadcasts, and the fewest rows of a key that it takes for hot.
HOT_KEYS, HOT = 50_000, 500


def join_totals(rows: DataFrame, totals: DataFrame, key: str, total: int, size: str = "n") -> DataFrame:
    """Inner join of ``rows`` with a row for each key, whose column ``size`` is the key's number of rows.

    A hot key would land in one task. Keys with more than their share of ``total``, the number of rows at most, are
    broadcast, which are HOT_KEYS at most; their rows go to the join of all other keys too, but under a hash of the
    row, so that they are spread, and what they may meet there is left aside. ``totals`` is read twice. Columns of
    ``rows`` and ``totals`` differ but for the key; rows with a null key go.
    """
    hot, others = max(HOT, total // HOT_KEYS), [c for c in totals.columns if c != key]
    crowded = totals.where(F.col(size) > hot).select(key, *[F.col(c).alias(f"_hot_{c}") for c in others], F.lit(True).alias("_hot"))
    usual = totals.where(F.col(size) <= hot).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_usual_{c}") for c in others], F.lit(True).alias("_usual"))
    met = rows.where(F.col(key).isNotNull()).join(F.broadcast(crowded), key, "left")
    spread = F.xxhash64(*rows.columns).cast("string").cast(rows.schema[key].dataType)
    met = met.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread)).join(usual, "_key", "left")
    is_hot = F.col("_hot").isNotNull()
    met = met.where(is_hot | F.col("_usual").isNotNull())
    return met.select(*rows.columns, *[F.when(is_hot, F.col(f"_hot_{c}")).otherwise(F.col(f"_usual_{c}")).alias(c) for c in others])


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with columns named by place, for steps that must not depend on a user's names (dots, other case)."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow for functions from a batch to columns by name, with one output type check."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield pa.RecordBatch.from_pydict(function(part), schema=kinds)

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes each (one long row stays whole)."""
    at, n = 0, batch.num_rows
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    while at < n:
        yield batch.slice(at, step)
        at += step


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def large_texts(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, by name, so that extra columns with clashing names can't interfere."""
    return df.select(*[df[c] for c in columns])
