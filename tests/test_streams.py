import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tracewright.streaming import stateful as S
from tracewright.streaming.place import shared_dir


def stream(spark, rows, schema, parts=3):
    """A stream that gives the rows in several batches, in order."""
    root = shared_dir(spark)
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(spark.read.parquet(root).schema).option("maxFilesPerTrigger", 1).parquet(root)


def test_replay_ratios(spark):
    rows = [(i % 4, i, 1.0 if (i // 4) % 5 or i % 4 == 0 else 0.0) for i in range(60)]
    want = {}
    for uid, _, acc in rows:
        want[uid] = max(0.04, want.get(uid, 1.0) * 0.5) if acc == 1 else 1.0
    got = {r.uid: r.ratio for r in S.drained(S.replay_ratios(stream(spark, rows, "uid long, row_id long, acc double")), "update", ["uid"]).collect()}
    assert got == want


DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
TIMED = "uid long, ts timestamp, row_id long, entry string"


def timed(spark, rows, parts):
    """Rows (uid, seconds, row_id, entry), dealt in order of row_id to so many arrivals, with a last row that closes all."""
    rows = [(u, DAY + timedelta(seconds=s), i, e) for u, s, i, e in rows]
    size = -(-len(rows) // parts)
    cut = [rows[k * size : (k + 1) * size] for k in range(parts)] + [[(99, DAY + timedelta(days=40), 10**6, None)]]
    return [spark.createDataFrame(c, TIMED) for c in cut if c]


def told(out):
    return {r.row_id: r.answer for r in out.collect() if r.uid != 99}


@pytest.mark.parametrize("parts", [1, 3])
def test_buffers(spark, parts):
    rng = random.Random(1)
    rows = [(i % 3 or None, 600 * i + rng.randrange(-3000, 3000) + 4000, i, rng.choice(["a", "b", "c", "d", None])) for i in range(200)]
    got = told(S.after_arrivals(timed(spark, rows, parts), lambda e: S.buffers(e, 2, 86_400_000, "3 hours")))
    held, added, want = {}, {}, {}
    for uid, at, i, entry in sorted(rows, key=lambda r: (r[1], r[2])):
        mine, key = held.setdefault(uid, []), (uid, at // 86_400)
        if entry and entry not in mine and added.get(key, 0) < 2:
            mine.append(entry)
            del mine[:-2]
            added[key] = added.get(key, 0) + 1
        want[i] = ",".join(mine)
    assert got == want


@pytest.mark.parametrize("parts", [1, 4])
def test_rate_limit(spark, parts):
    rng = random.Random(2)
    rows = [(i % 2, 40 * i + rng.randrange(1000) + (200_000 if i > 90 else 0), i, None) for i in range(180)]
    progress = []
    got = told(S.after_arrivals(timed(spark, rows, parts), lambda e: S.rate_limited(e, 1 / 90, 2.0, 3_600_000, "1 hour"), progress=progress))
    level, last, want = {}, {}, {}
    for uid, at, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        s = DAY.timestamp() + at
        level[uid] = min(2.0, level.get(uid, 2.0) + (s - last.get(uid, 0.0)) / 90)
        last[uid] = max(last.get(uid, 0.0), s)
        want[i] = level[uid] >= 1
        level[uid] -= want[i]
    assert got == want and len(set(want.values())) == 2
    # All that waited has left the state, and idle keys are forgotten; the last row's wait stays.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) > progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_rows_that_wait_keep_a_fold_from_being_forgotten(spark):
    # The watermark, at 4,000 s, is past the idle time of the first hour's rows; the third row waits for its hour's end.
    rows = [(0, 3590, 0, None), (0, 3591, 1, None), (0, 3605, 2, None), (1, 7600, 3, None)]
    progress = []
    got = told(S.after_arrivals(timed(spark, rows, 1), lambda e: S.rate_limited(e, 1 / 90, 2.0, 3_600_000, "1 hour"), progress=progress))
    assert got == {0: True, 1: True, 2: False, 3: True}


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_spans_of_any_size_fold_in_order(spark, most, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 2, 900 * i + rng.randrange(-5000, 5000) + 6000, i, None) for i in range(60)]
    monkeypatch.setattr(S.InOrder.__init__, "__defaults__", (most,))
    step = lambda fold, row, bucket: ((fold[0] + 1,), fold[0])
    fold = lambda e: S.in_order(e, "", "n long", (0,), step, "long", 3_600_000, "3 hours")
    got = told(S.after_arrivals(timed(spark, rows, 3), fold))
    want = {i: n for u in (0, 1) for n, (_, i) in enumerate(sorted((s, i) for v, s, i, _ in rows if v == u))}
    assert got == want


def test_windows_leave_the_state_and_late_rows_go(spark):
    at = lambda h, m=0: DAY + timedelta(hours=h, minutes=m)
    parts = [[(at(1), "a", 1.0), (at(2), "a", 2.0), (at(8), "b", 4.0), (at(20), "a", 8.0)], [(at(3), "a", 16.0), (at(18, 30), "a", 32.0), (at(17, 59), "b", 64.0), (at(50), "a", 1.0)]]
    progress = []
    frames = [spark.createDataFrame(p, "ts timestamp, event_type string, value double") for p in parts]
    out = S.after_arrivals(frames, lambda e: S.windowed(e, "6 hours", late="1 hour"), progress=progress)
    assert sorted((r.start.hour, r.event_type, r.n, r.total) for r in out.collect()) == [(0, "a", 2, 3.0), (6, "b", 1, 4.0), (18, "a", 2, 40.0)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 2


def test_a_run_that_is_cut_off_loses_and_repeats_nothing(spark):
    rows = [(i % 5, i, 1.0) for i in range(60)]
    sums = stream(spark, rows, "uid long, row_id long, acc double", 6).groupBy("uid").agg(F.count("*").alias("n"), F.sum("row_id").alias("total"))
    root = shared_dir(spark)
    for at in (0, 2, 3, 5):
        with pytest.raises(StreamingQueryException):
            S.run(sums, root, "update", at)
    assert len(S.run(sums, root, "update")) == 1
    got = {r.uid: (r.n, r.total) for r in S.written_batches(sums, root, "update", ["uid"]).collect()}
    assert got == {u: (12, sum(i for i in range(60) if i % 5 == u)) for u in range(5)}


def test_late_events_are_dropped(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [(at(1), "a", 1.0), (at(2), "a", 1.0), (at(20), "a", 1.0), (at(20), "b", 1.0), (at(21), "a", 1.0), (at(21), "b", 1.0), (at(1), "a", 9.0), (at(22), "a", 1.0)]
    s = stream(spark, rows, "ts string, event_type string, value double", 4).withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.drained(S.windowed(s, "6 hours", late="1 hour"), "append").collect()
    assert [(r.event_type, r.n, r.total) for r in out] == [("a", 2, 2.0)]


def test_last_rates(spark):
    rows = [(i % 5, i, float(i * i % 3 > 0)) for i in range(100)]
    got = {r.uid: (round(r.rate, 9), r.n) for r in S.drained(S.last_rates(stream(spark, rows, "uid long, row_id long, acc double"), 3), "update", ["uid"]).collect()}
    assert got == {u: (round(sum([a for v, _, a in rows if v == u][-3:]) / 3, 9), 20) for u in range(5)}


def test_accumulated_over_batches(spark):
    rows = [(i * 7 % 23 if i < 40 else i % 31, i) for i in range(90)]
    got = {r.uid: r.batch for r in S.accumulated(stream(spark, rows, "uid long, row_id long"), 4).collect()}
    order = list(dict.fromkeys(u for u, _ in rows))
    assert got == {u: k // 4 for k, u in enumerate(order) if k < len(order) // 4 * 4}
