"""Readers and writers of trajectory files, logs, task lists, annotations and metrics."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARGUMENTS = "action string, coordinate array<int>, coordinate2 array<int>, start_coordinate array<int>, pixels int, text string, keys array<string>, time double, button string, status string"
STEP = (
    "step int, query string, thought string, action string, pixel array<int>, plan struct<name:string,arguments:struct<"
    + ARGUMENTS.replace(", ", ",").replace(" ", ":")
    + ">>, bbox array<array<int>>, bbox2 array<array<int>>, screenshot string, code string, is_use boolean, is_reviewed boolean, is_delete boolean, train_test string, raw_thought string"
)
EPISODE = "task string, app string, device string, screen_resolution array<int>, query string, episode_id string, is_delete boolean, is_mock boolean, verified boolean, task_completed boolean"
DESKTOP_LOG = "step_num int, action_timestamp string, action string, response string, natural_language_action string, screenshot_file string"
MOBILE_LOG = "map<string, struct<traj: array<struct<task_goal: string, step: int, prediction: string, action: string>>>>"


def path() -> Column:
    return F.col("_metadata.file_path")


def read_episodes(spark: SparkSession, root: str, glob: str = "task.json", lines: bool = True) -> DataFrame:
    """Episodes of all matching files below a folder; a file holds one document, or one a line."""
    kind = T.StructType.fromDDL(EPISODE).add("data", T.ArrayType(T.StructType.fromDDL(STEP)))
    return spark.read.schema(kind).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(root)


def episodes(spark: SparkSession, root: str) -> DataFrame:
    """Every ``task.json`` below a folder, one row each, with its folder; files inside another trajectory's folder don't count."""
    df = read_episodes(spark, root, lines=False)
    df = df.withColumn("folder", F.regexp_replace(path(), "/task\\.json$", ""))
    above = df.select(F.concat("folder", F.lit("/")).alias("_above"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/")) - 1), lambda n: F.concat(F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"), F.lit("/")))
    nested = df.select("folder", F.explode(prefixes).alias("_above")).join(above, "_above", "left_semi").select("folder").distinct()
    return df.join(nested, "folder", "left_anti")


def placed(df: DataFrame, root_depth: int = 2) -> DataFrame:
    """Adds app and episode of ``root/app/episode`` folders (app null for ``root/episode``, at depth 1)."""
    parts = F.split("folder", "/")
    app = F.element_at(parts, -2) if root_depth == 2 else F.lit(None).cast("string")
    return df.withColumn("folder_app", app).withColumn("folder_episode", F.element_at(parts, -1))


def exploded(df: DataFrame) -> DataFrame:
    """One row a step with the episode's columns; empty boxes become null."""
    s = df.select(*[c for c in df.columns if c != "data"], F.posexplode("data").alias("pos", "_s"))
    step = s.select(*[c for c in s.columns if c != "_s"], *[F.col(f"_s.{f.name}").alias(f"step_{f.name}" if f.name in s.columns else f.name) for f in T.StructType.fromDDL(STEP)])
    return step.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("bbox", "bbox2")})


def json_lines(spark: SparkSession, root: str, schema: str = DESKTOP_LOG, strict: bool = False) -> DataFrame:
    """Lines of ``*.jsonl`` files with their file; a bad line is left out, or an error if ``strict``."""
    return read_json_lines(spark, root, "*.jsonl", schema, strict)


def read_json_lines(spark: SparkSession, root: str, glob: str, schema: str = DESKTOP_LOG, strict: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(root).withColumn("file", path())


def mobile_logs(spark: SparkSession, root: str) -> DataFrame:
    """Steps of the first run in each ``traj.json``."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "traj.json").text(root)
    first = F.map_values(F.from_json("value", MOBILE_LOG))[0]["traj"]
    return df.select(path().alias("file"), F.posexplode(first).alias("pos", "s")).select("file", "pos", "s.*")


def results(spark: SparkSession, root: str, labelled: bool = False) -> DataFrame:
    """(folder, score) of ``result.txt`` files: a number (0 if it is none), or after ``score:`` (null if there is none)."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "result.txt").text(root)
    if labelled:
        score = F.regexp_extract("value", r"score:\s*([\d.]+)", 1).try_cast("double")
    else:
        score = F.coalesce(F.trim(F.regexp_replace("value", r"\s+", " ")).try_cast("double"), F.lit(0.0))
    return df.select(F.regexp_replace(path(), "/result\\.txt$", "").alias("folder"), score.alias("score"))


def screenshots(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """(file, run, step) of screenshots named ``...-run-step.png``; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    number = lambda g: F.regexp_extract("path", r"-(\d+)-(\d+)\.png$", g).try_cast("int")
    return df.select(F.col("path").alias("file"), number(1).alias("run"), number(2).alias("step"))


def csv_tasks(spark: SparkSession, root: str) -> DataFrame:
    """Task lists with their columns under one name, a byte order mark removed, defaults filled in."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(root)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    if "original_query" in df.columns and "instruction" not in df.columns:
        df = df.withColumnRenamed("original_query", "instruction")
    for name, default in (("domain", ""), ("needs_precondition", ""), ("precondition_type", ""), ("what_to_prepare", "")):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    return df


def app_definitions(spark: SparkSession, root: str) -> DataFrame:
    """(name, app) of each ``class X(`` in Python files, the app being the file's folder; the first path wins."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(root).withColumn("file", path())
    found = df.select(F.regexp_extract("value", r"^class\s+(\w+)\s*\(", 1).alias("name"), F.element_at(F.split("file", "/"), -2).alias("app"), "file").where("name <> ''")
    return found.groupBy("name").agg(F.min_by("app", "file").alias("app"))


def annotations(spark: SparkSession, root: str, box: str = "bbox", form: str = "xyxy") -> DataFrame:
    """JSON arrays of grounding samples with their box as array(x1, y1, x2, y2)."""
    return boxed(spark.read.option("multiLine", True).json(root), box, form)


def boxed(df: DataFrame, box: str, form: str) -> DataFrame:
    b = F.transform(box, lambda v: v.cast("double"))
    return df.withColumn("box", b if form == "xyxy" else F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]))


def rollout_dumps(spark: SparkSession, root: str) -> DataFrame:
    """Dumped rollouts with the step their file is named for."""
    df = spark.read.option("pathGlobFilter", "*.jsonl").json(root)
    return df.withColumn("step", F.regexp_extract(path(), r"(\d+)\.jsonl$", 1).try_cast("int"))


def several(spark: SparkSession, paths: list[str], most: int | None = None, seed: int | None = None, key: str | None = None) -> DataFrame:
    """Parquet sources one under the other; of ``most`` rows, the first by key or, with a seed, those of least hash."""
    from tracewright.operators.order import seeded

    out = None
    for p in paths:
        df = spark.read.parquet(p)
        out = df if out is None else out.unionByName(df)
    if most is None:
        return out
    return out.orderBy(*([seeded(key, seed=seed)] if seed is not None else []), key).limit(most)


def write_splits(train: DataFrame, test: DataFrame, root: str) -> dict[str, int]:
    """Writes both splits and counts what can be read back; an empty training set is an error, an empty test set isn't written."""
    spark = train.sparkSession
    if train.isEmpty():
        raise ValueError("no training rows")
    out = {}
    for name, df in (("train", train), ("test", test)):
        if name == "train" or not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{root}/{name}")
            out[name] = spark.read.parquet(f"{root}/{name}").count()
    return out


def write_json(df: DataFrame, root: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", False).json(root)


def write_files(df: DataFrame, root: str) -> None:
    """A file for each row of (path below ``root``, content): written by the tasks, a task that runs again writes the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if urlsplit(root).scheme else f"file://{root}")
        n = 0
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{base}/{path}"
                store.create_dir(name.rpartition("/")[0], recursive=True)
                with store.open_output_stream(name) as out:
                    out.write((content or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select(df[df.columns[0]].cast("string"), df[df.columns[1]].cast("string")).mapInArrow(write, "n long").collect()


def append_metrics(df: DataFrame, root: str, step: int) -> None:
    """(metric, value) rows of a step to one table for all trackers."""
    df.select("metric", F.col("value").cast("double").alias("value"), F.lit(step).cast("long").alias("step")).write.mode("append").parquet(root)


def grow(batch: DataFrame, root: str, longest: int) -> None:
    """Appends a batch to a growing table, without prompts longer than ``longest``."""
    batch.where(F.col("length") <= longest).write.mode("append").parquet(root)


def save_state(state: DataFrame, root: str, step: int) -> None:
    """A sampler's state of a step; steps stay side by side."""
    state.write.mode("overwrite").parquet(f"{root}/step={step}")


def latest_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The state of the last step saved, or None where nothing was."""
    try:
        df = spark.read.option("basePath", root).parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    last = df.agg(F.max("step")).first()[0]
    return df.where(F.col("step") == last).drop("step")
