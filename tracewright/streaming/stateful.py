"""Stateful stream operators and windows; each has a batch twin that a query compares."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """A table's files as a stream of batches of at most ``files``; times without a zone become instants, which event time needs."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parquet*")
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def run(stream: DataFrame, root: str, mode: str, fail_at: int | None = None) -> list[dict]:
    """Runs a stream to the end of the input there is, on from where the checkpoint under ``root`` stands; its progress by batch.

    Batches are written by number under ``root``, so a batch that runs again overwrites itself: a run that was cut off
    anywhere, started again, gives each row once. ``fail_at`` cuts a run off when that batch is written but not yet
    committed, for tests of just that.
    """

    def save(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        if n == fail_at:
            raise CutOff(n)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


class CutOff(RuntimeError):
    """A run that ``fail_at`` ended."""


def written_batches(stream: DataFrame, root: str, mode: str, key: list[str] | None = None) -> DataFrame:
    """What the runs under ``root`` gave; of updates to a key the last stays."""
    spark = stream.sparkSession
    out = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{root}/out").parquet(f"{root}/out")
    if mode == "complete":
        return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")
    if not key:
        return out.drop("batch")
    rest = F.struct("batch", *[c for c in out.columns if c not in (*key, "batch")])
    last = out.groupBy(*key).agg(F.max_by(rest, "batch").alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in out.columns if c not in (*key, "batch")])


def drained(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """All that a stream gives for the input there is, in a table in the folder that executors share."""
    from tracewright.streaming.place import shared_dir

    root = shared_dir(stream.sparkSession)
    run(stream, root, mode)
    return written_batches(stream, root, mode, key)


def after_arrivals(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append", key: list[str] | None = None, progress: list[dict] | None = None) -> DataFrame:
    """What a stream gives whose input arrives in parts, with a run of its own for each, on from the checkpoint of the last.

    A run ends with its watermark at work: what it closes is written and leaves the state, and a later part's rows
    behind it are late and go. ``build`` makes the stream of its input; ``progress`` gets the runs' progress.
    """
    from tracewright.streaming.place import shared_dir

    spark = parts[0].sparkSession
    root = shared_dir(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        found = run(stream, root, mode)
        if progress is not None:
            progress += found
    return written_batches(stream, root, mode, key)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows, dropping what comes later than the watermark."""
    e = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def _replay(decay: float, least: float):
    # This many successes in a row reach the least ratio, so what came before them has no effect.
    enough = 1
    while decay**enough > least and 0 < decay < 1:
        enough += 1

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratio = state.get[0] if state.exists else 1.0
        failed, right = None, []
        for frame in frames:  # one frame at a time: the last failure, and the newest successes after it
            bad = frame.row_id[frame.acc != 1]
            if len(bad):
                failed = int(bad.max()) if failed is None else max(failed, int(bad.max()))
            good = frame.row_id[frame.acc == 1]
            right = sorted([r for r in (*right, *good.nlargest(enough).tolist()) if failed is None or r > failed])[-enough:]
        ratio = ratio if failed is None else 1.0
        for _ in right:
            ratio = max(least, ratio * decay)
        state.update((ratio,))
        yield pd.DataFrame({"uid": [key[0]], "ratio": [ratio]})

    return update


def replay_ratios(feedback: DataFrame, decay: float = 0.5, least: float = 0.04) -> DataFrame:
    """Each prompt's sampling ratio after feedback (uid, row_id, acc): decayed at a success, 1 after anything else."""
    return feedback.select("uid", "row_id", "acc").groupBy("uid").applyInPandasWithState(_replay(decay, least), "uid long, ratio double", "ratio double", "update", GroupStateTimeout.NoTimeout)


def _rated(keep: int):
    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        new: list[tuple] = []
        for frame in frames:  # one at a time: the newest few are enough
            n += len(frame)
            last = frame.nlargest(keep, "row_id")
            new = sorted([*new, *zip(last.row_id.tolist(), last.acc.tolist())])[-keep:]
        held = [*held, *(acc for _, acc in new)][-keep:]
        state.update((held, n))
        yield pd.DataFrame({"uid": [key[0]], "rate": [sum(held) / len(held)], "n": [n]})

    return update


def last_rates(feedback: DataFrame, keep: int = 3) -> DataFrame:
    """Each prompt's mean over its last ``keep`` observations (uid, row_id, acc) and how many there were; batches come in order."""
    return feedback.select("uid", "row_id", "acc").groupBy("uid").applyInPandasWithState(_rated(keep), "uid long, rate double, n long", "held array<double>, n long", "update", GroupStateTimeout.NoTimeout)


def accumulated(rows: DataFrame, size: int) -> DataFrame:
    """(uid, batch): prompts in order of arrival fill batches of ``size``; those of an unfinished batch wait.

    ``rows`` is a stream of (uid, row_id). Each of its batches adds the prompts that are new to a state table, numbered
    on from those before; a batch that runs again overwrites what it wrote.
    """
    from tracewright.operators.order import numbered
    from tracewright.streaming.place import shared_dir

    spark, root = rows.sparkSession, shared_dir(rows.sparkSession)
    schema = "uid long, pos long"
    spark.createDataFrame([], schema).write.parquet(f"{root}/state/batch=-1")
    kept = lambda: spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/state").parquet(f"{root}/state")

    def add(df: DataFrame, n: int) -> None:
        before = kept().where(F.col("batch") < n)
        new = df.groupBy("uid").agg(F.min("row_id").alias("first")).join(before, "uid", "left_anti")
        placed = numbered(new, "first").select("uid", (F.col("pos") + F.lit(before.count())).cast("long").alias("pos"))
        placed.write.mode("overwrite").parquet(f"{root}/state/batch={n}")

    rows.select("uid", "row_id").writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    whole = kept().count() // size * size
    return kept().where(F.col("pos") < whole).select("uid", F.floor(F.col("pos") / size).alias("batch"))


class InOrder(StatefulProcessor):
    """Folds each key's rows in order of event time, whatever batches they come in.

    Rows wait in the state in spans of buckets of time, apart from each other and of at most ``most`` rows, or of one
    bucket. A timer at the first bucket's end fires once the watermark has passed it, so that no row of it can come any
    more; then the rows of all buckets that have ended are folded, span by span, and leave. At most a span of a key is
    held in memory. Where ``idle`` is given, a key's fold is forgotten after as long without rows, waiting ones included.
    """

    def __init__(self, columns: str, state: str, begin: tuple, step: Callable, width: int, idle: int | None, most: int = 4096) -> None:
        self.columns, self.state, self.begin, self.step, self.width, self.idle, self.most = columns, state, begin, step, width, idle, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket long", ", ".join(f"{n} array<{t}>" for n, t in (c.split() for c in self.columns.split(", "))))
        self.kept = handle.getValueState("kept", f"{self.state}, until long, firsts array<long>, lasts array<long>")
        self.names = [c.split()[0] for c in self.columns.split(", ")]

    def _bucket(self, row: tuple) -> int:
        return row[0] // (self.width * 1000)

    def _read(self) -> tuple:
        """The fold, until when it counts, and the first and the last bucket of each span."""
        *fold, until, firsts, lasts = self.kept.get() or (*self.begin, 0, [], [])
        return tuple(fold), until, list(firsts), list(lasts)

    def _taken(self, first: int) -> list[tuple]:
        rows = self.held.getValue((first,))
        self.held.removeKey((first,))
        return list(zip(*rows))

    def _put(self, rows: list[tuple]) -> list[tuple[int, int]]:
        """Rows in order as spans of whole buckets."""
        spans, at = [], 0
        while at < len(rows):
            end = len(rows)
            if end - at > self.most:
                cut = self._bucket(rows[at + self.most])
                end = bisect_left(rows, cut, at, key=self._bucket)
                end = end if end > at else bisect_right(rows, cut, at, key=self._bucket)
            spans.append((self._bucket(rows[at]), self._bucket(rows[end - 1])))
            self.held.updateValue((spans[-1][0],), tuple(map(list, zip(*rows[at:end]))))
            at = end
        return spans

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, until, firsts, lasts = self._read()
        timer = firsts[:1]
        for frame in rows:
            new = sorted(zip(*[frame[n].tolist() for n in self.names]), key=lambda r: r[:2])
            spans, at = [], 0
            for first, last in zip(firsts, lasts):
                low = bisect_left(new, first, at, key=self._bucket)
                high = bisect_right(new, last, low, key=self._bucket)
                spans += self._put(new[at:low])
                spans += self._put(sorted(self._taken(first) + new[low:high], key=lambda r: r[:2])) if high > low else [(first, last)]
                at = high
            spans += self._put(new[at:])
            firsts, lasts = [s[0] for s in spans], [s[1] for s in spans]
        if firsts[:1] != timer:
            self.handle.registerTimer((firsts[0] + 1) * self.width)
        self.kept.update((*fold, until, firsts, lasts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, until, firsts, lasts = self._read()
        ended, out = timerValues.getCurrentWatermarkInMs() // self.width, []
        folded = bool(firsts) and firsts[0] < ended
        while firsts and firsts[0] < ended:
            rows = self._taken(firsts.pop(0))
            last, n = lasts.pop(0), len(rows)
            if last >= ended:
                n = bisect_left(rows, ended, key=self._bucket)
                rest = self._put(rows[n:])
                firsts, lasts = [s[0] for s in rest] + firsts, [s[1] for s in rest] + lasts
            for row in rows[:n]:
                bucket = self._bucket(row)
                fold, answer = self.step(fold, row, bucket)
                out.append((key[0], row[1], bucket, answer))
            until = (self._bucket(rows[n - 1]) + 1) * self.width + (self.idle or 0) + 1
            if len(out) >= 10_000:
                yield self._frame(out)
                out = []
        if not firsts and self.idle is not None and until <= timerValues.getCurrentWatermarkInMs():
            # Idle, and nothing waits; a fold that was put off by later rows has a later timer.
            self.kept.clear()
        elif folded:
            if firsts:
                self.handle.registerTimer((firsts[0] + 1) * self.width)
            elif self.idle is not None:
                self.handle.registerTimer(until)
            self.kept.update((*fold, until, firsts, lasts))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("uid", "row_id", "bucket", "answer"), map(list, zip(*out)))))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, columns: str, state: str, begin: tuple, step: Callable, answer: str, width: int, late: str, idle: int | None = None) -> DataFrame:
    """(uid, row_id, bucket, answer): each row's answer from a fold over its key's rows in order of (ts, row_id).

    ``rows`` is a stream of uid, ts, row_id and what ``columns`` names after micros and row_id; ``step`` goes from
    (fold, row, bucket) to (fold, answer). Answers come once the watermark, ``late`` behind the latest row, has passed
    the end of the row's bucket of ``width`` milliseconds; rows behind the watermark go. A null uid is a key of its own.
    """
    columns = f"micros long, row_id long{columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    timed = rows.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts")).select("uid", "ts", *names)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return timed.groupBy("uid").transformWithStateInPandas(InOrder(columns, state, begin, step, width, idle), f"uid {dict(rows.dtypes)['uid']}, row_id long, bucket long, answer {answer}", "Append", "eventTime")


DAY = 86_400_000


def buffers(entries: DataFrame, size: int, width: int = DAY, late: str = "1 hour") -> DataFrame:
    """(uid, row_id, bucket, answer): each prompt's newest distinct entries after each row, joined by commas.

    ``entries`` is a stream of uid, ts, row_id, entry. A buffer takes at most ``size`` new entries in a bucket of time
    (of ``width`` milliseconds), and the oldest leave first.
    """

    def step(fold: tuple, row: tuple, bucket: int) -> tuple:
        held, added, last = list(fold[0]), fold[1], fold[2]
        added = added if last == bucket else 0
        if added < size and row[2] is not None and row[2] not in held:
            held, added = [*held, row[2]][-size:], added + 1
        return (held, added, bucket), ",".join(held)

    return in_order(entries, ", entry string", "held array<string>, added long, last long", ([], 0, -1), step, "string", width, late)


def rate_limited(requests: DataFrame, rate: float, most: float, width: int = DAY, late: str = "1 hour") -> DataFrame:
    """(uid, row_id, bucket, answer): whether each request passes its key's token bucket, which fills by event time.

    ``requests`` is a stream of uid, ts, row_id. A key that was idle until its bucket is full again is forgotten.
    """

    def step(fold: tuple, row: tuple, bucket: int) -> tuple:
        level, last = fold
        seconds = row[0] / 1e6
        level = min(most, level + max(0.0, seconds - last) * rate)
        passed = level >= 1
        return (level - passed, max(last, seconds)), passed

    return in_order(requests, "", "level double, last double", (most, 0.0), step, "boolean", width, late, int(most / rate * 1000) + 1)
