"""Queries of streams: what a stream gives once its input has run through, against the same in batch."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tracewright.plans.registry import query
from tracewright.sources import files
from tracewright.sources import fixtures as X
from tracewright.sources.dataset import register_dataset
from tracewright.streaming import stateful as S

R = "WITH " + X.ROLLOUTS


# The stream arrives in two parts; the second has the later days and one in ten of the earlier rows, late.
LATER = "(event_id % 10 = 0 OR ts >= TIMESTAMP '2024-01-16 00:00:00')"
# Watermarks after the first part and at the end, an hour behind the latest row.
MARKS = f"marks AS (SELECT max(ts) FILTER (WHERE NOT {LATER}) - INTERVAL 1 HOUR AS first, max(ts) - INTERVAL 1 HOUR AS last FROM events)"


def arrivals(spark, d):
    e = X.read(spark, d, "events")
    e = e.withColumns({c: e[c].cast("timestamp") for c, kind in e.dtypes if kind == "timestamp_ntz"})
    return [e.where(f"NOT {LATER}"), e.where(LATER)]


@query(f"WITH {MARKS}, e AS (SELECT *, {LATER} AS late, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, marks WHERE start + INTERVAL 6 HOUR <= last AND NOT (late AND start + INTERVAL 6 HOUR <= first) GROUP BY 1, 2")
def st_tumbling(spark, d):
    """Windows that the watermark has closed; rows that come after their window was closed go."""
    return S.after_arrivals(arrivals(spark, d), lambda e: S.windowed(e, "6 hours"))


@query(f"WITH {MARKS}, e AS (SELECT *, {LATER} AS late, time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR * k AS start FROM events, (VALUES (0), (1)) o(k)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, marks WHERE start + INTERVAL 6 HOUR <= last AND NOT (late AND start + INTERVAL 6 HOUR <= first) GROUP BY 1, 2")
def st_sliding(spark, d):
    return S.after_arrivals(arrivals(spark, d), lambda e: S.windowed(e, "6 hours", "3 hours"))


def _sessions(rows, name):
    edge = "CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new"
    return f"{name}_o AS (SELECT *, {edge} FROM {rows}), {name}_k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {name}_o), {name} AS (SELECT *, min(ts) OVER w AS start, max(ts) OVER w + INTERVAL 4 HOUR AS stop FROM {name}_k WINDOW w AS (PARTITION BY user_id, k))"


@query(f"WITH {MARKS}, early AS (SELECT user_id, event_id, ts FROM events WHERE NOT {LATER}), {_sessions('early', 'a')}, closed AS (SELECT * FROM a, marks WHERE stop <= first), still AS (SELECT user_id, event_id, ts FROM a, marks WHERE stop > first UNION ALL SELECT user_id, event_id, ts FROM events, marks WHERE {LATER} AND ts + INTERVAL 4 HOUR > first), {_sessions('still', 'b')}, done AS (SELECT user_id, start FROM closed UNION ALL SELECT user_id, start FROM b, marks WHERE stop <= last) SELECT user_id, start, count(*) AS n FROM done GROUP BY 1, 2")
def st_sessions(spark, d):
    """Sessions that the watermark has closed; a late row whose own session would be closed goes, another begins or joins an open one."""
    return S.after_arrivals(arrivals(spark, d), lambda e: S.sessions(e, "4 hours"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def st_restart(spark, d):
    """Sums by user over a stream that is cut off after it wrote its third batch, and again later, and started anew."""
    from tracewright.streaming.place import shared_dir

    root = shared_dir(spark)
    for k in range(6):
        X.read(spark, d, "events").where(f"event_id % 6 = {k}").coalesce(1).write.mode("append").parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    sums = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    for at in (2, 4, None):
        try:
            S.run(sums, root, "update", at)
        except StreamingQueryException:
            continue
    return S.written_batches(sums, root, "update", ["user_id"]).select("user_id", "n", F.round("total", 4).alias("total"))


def _halved(rows, step):
    """Of each step the orders whose key it divides, at half the price."""
    import pyarrow.compute as pc

    keys = rows.column("o_orderkey")
    mine = rows.filter(pc.equal(pc.subtract(keys, pc.multiply(pc.divide(keys, step + 1), step + 1)), 0))
    at = mine.schema.get_field_index("o_totalprice")
    return mine.set_column(at, "o_totalprice", pc.divide(mine.column(at), 2.0))


GENERATED = "SELECT o_orderkey, round(CASE WHEN step = 0 THEN o_totalprice ELSE o_totalprice / 2.0 END, 4)::DOUBLE AS price, step FROM orders, (VALUES (0), (1), (2), (3)) s(step) WHERE (step = 0 OR o_orderkey % (step + 1) = 0)"


@query(f"{GENERATED} AND o_custkey > 20 AND step <> 1 AND step < 3 AND o_orderstatus IN ('F', 'O')")
def scan_generated_dataset(spark, d):
    """A table and what steps generate from its rows, read as a data source; its filters are made where rows are read."""
    register_dataset(spark, "halved", _halved)
    o = spark.read.format("halved").option("path", f"{d}/orders.parquet").option("steps", 3).load()
    o = o.where((F.col("o_custkey") > 20) & F.col("step").isin(0, 2) & (F.col("step") < 3) & F.col("o_orderstatus").isin("F", "O"))
    return o.select("o_orderkey", F.round("o_totalprice", 4).cast("double").alias("price"), "step")


@query(GENERATED)
def st_generated_dataset(spark, d):
    """The same as a stream, stopped after one step and started again for the others."""
    from tracewright.streaming.place import shared_dir

    register_dataset(spark, "halved", _halved)
    root = shared_dir(spark)
    for steps in (1, 3):
        s = spark.readStream.format("halved").option("path", f"{d}/orders.parquet").option("steps", steps).load()
        s = s.select("o_orderkey", F.round("o_totalprice", 4).cast("double").alias("price"), "step")
        S.run(s, root, "append")
    return S.written_batches(s, root, "append")


RATIO = "o AS (SELECT uid, row_id, acc, row_number() OVER (PARTITION BY uid ORDER BY row_id) AS n FROM rollouts), e AS (SELECT uid, max(n) - coalesce(max(n) FILTER (WHERE acc = 0), 0) AS streak FROM o GROUP BY 1)"


@query(f"{R}, {RATIO} SELECT uid, round(greatest(0.04, pow(0.5, streak)), 6) AS ratio FROM e")
def st_replay_sampler(spark, d):
    e = S.table_stream(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("row_id"), (F.col("value") > 50).cast("double").alias("acc"))
    return S.drained(S.replay_ratios(e), "update", ["uid"]).withColumn("ratio", F.round("ratio", 6))


@query(f"{R}, o AS (SELECT uid, acc, row_number() OVER (PARTITION BY uid ORDER BY row_id DESC) AS k FROM rollouts) SELECT uid, round(avg(acc) FILTER (WHERE k <= 3), 6) AS rate, count(*) >= 2 AND avg(acc) FILTER (WHERE k <= 3) > 46.9999 / 48 AS solved FROM o GROUP BY 1")
def st_filter_sampler(spark, d):
    """As a stream: a prompt's mean over its last three observations; solved ones leave the sampler."""
    e = S.table_stream(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("row_id"), (F.col("value") > 50).cast("double").alias("acc"))
    r = S.drained(S.last_rates(e, 3), "update", ["uid"])
    return r.select("uid", F.round("rate", 6).alias("rate"), ((F.col("n") >= 2) & (F.col("rate") > 46.9999 / 48)).alias("solved"))


@query(f"{R}, p AS (SELECT uid, min(row_id) AS first FROM rollouts WHERE acc = 1 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY first) AS k FROM p) SELECT uid, floor((k - 1) / 8)::BIGINT AS batch FROM o WHERE k <= floor((SELECT count(*) FROM o) / 8) * 8")
def st_group_accumulate(spark, d):
    """As a stream: prompts with a right answer fill batches of eight in order of arrival."""
    e = S.table_stream(spark, d, "events").where("value > 50")
    return S.accumulated(e.select(F.col("user_id").alias("uid"), F.col("event_id").alias("row_id")), 8)


KEPT = f"kept AS (SELECT user_id AS uid, event_id AS row_id, ts, value, props, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events, marks WHERE NOT ({LATER} AND ts <= first)), days AS (SELECT *, day + INTERVAL 1 DAY <= last AS told FROM kept, marks)"


@query(f"WITH RECURSIVE {MARKS}, {KEPT}, o AS (SELECT *, json_extract_string(props, '$.k') AS entry, row_number() OVER (PARTITION BY uid ORDER BY ts, row_id) AS n FROM days WHERE value > 50 AND told), f AS (SELECT uid, NULL::BIGINT AS row_id, 0::BIGINT AS n, NULL::TIMESTAMP AS day, 0 AS added, []::VARCHAR[] AS held FROM (SELECT DISTINCT uid FROM o) UNION ALL SELECT o.uid, o.row_id, o.n, o.day, a.added + a.new, CASE WHEN a.new = 0 THEN f.held WHEN len(f.held) < 3 THEN f.held || [o.entry] ELSE f.held[2:] || [o.entry] END FROM f JOIN o ON o.uid = f.uid AND o.n = f.n + 1, LATERAL (SELECT CASE WHEN f.day = o.day THEN f.added ELSE 0 END AS added, (CASE WHEN f.day = o.day THEN f.added ELSE 0 END < 3 AND o.entry IS NOT NULL AND NOT list_contains(f.held, o.entry))::INT AS new) a) SELECT uid, row_id, array_to_string(held, ',') AS held FROM f WHERE n > 0")
def st_thought_buffer_stream(spark, d):
    """Each prompt's buffer of three entries after each right answer, in order of time, over two arrivals."""
    e = [p.where("value > 50").select(F.col("user_id").alias("uid"), "ts", F.col("event_id").alias("row_id"), F.get_json_object("props", "$.k").alias("entry")) for p in arrivals(spark, d)]
    return S.after_arrivals(e, lambda s: S.buffers(s, 3)).select("uid", "row_id", F.col("answer").alias("held"))


@query(f"WITH RECURSIVE {MARKS}, {KEPT}, o AS (SELECT uid, row_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY uid ORDER BY ts, row_id) AS n FROM days WHERE told), f AS (SELECT uid, NULL::BIGINT AS row_id, 0::BIGINT AS n, 2.0::DOUBLE AS level, 0.0::DOUBLE AS last, false AS passed FROM (SELECT DISTINCT uid FROM o) UNION ALL SELECT o.uid, o.row_id, o.n, l.level - (l.level >= 1)::INT, greatest(f.last, o.s), l.level >= 1 FROM f JOIN o ON o.uid = f.uid AND o.n = f.n + 1, LATERAL (SELECT least(2.0, f.level + greatest(0.0, o.s - f.last) * (1.0 / 7200)) AS level) l) SELECT uid, row_id, passed FROM f WHERE n > 0")
def st_rate_limit(spark, d):
    """Each user's token bucket over the events in order of time, over two arrivals."""
    e = [p.select(F.col("user_id").alias("uid"), "ts", F.col("event_id").alias("row_id")) for p in arrivals(spark, d)]
    return S.after_arrivals(e, lambda s: S.rate_limited(s, 1 / 7200, 2.0)).select("uid", "row_id", F.col("answer").alias("passed"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents) ORDER BY doc_id LIMIT 50")
def scan_parquet_multi(spark, d):
    path = f"{d}/documents.parquet"
    return files.several(spark, [path, path], 50, key="doc_id").select("doc_id", "source")


@query(f"{R}, m AS (SELECT data_source AS metric, avg(score) AS value FROM rollouts GROUP BY 1) SELECT metric, round(value, 6) AS value, 3::BIGINT AS step FROM m")
def sink_metrics(spark, d):
    """A metrics table, appended to and read back."""
    from tracewright.streaming.place import shared_dir

    root = shared_dir(spark)
    files.append_metrics(X.rollouts(spark, d).groupBy(F.col("data_source").alias("metric")).agg(F.avg("score").alias("value")), root, 3)
    return spark.read.parquet(root).select("metric", F.round("value", 6).alias("value"), "step")


@query(f"WITH {X.STEPS}, r AS (SELECT episode_id, row_number() OVER (ORDER BY md5('42:' || episode_id), episode_id) AS n FROM (SELECT DISTINCT episode_id FROM steps)) SELECT CASE WHEN n <= 5 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM steps JOIN r USING (episode_id) GROUP BY 1")
def sink_parquet(spark, d):
    """Splits written, read back and counted."""
    from tracewright.operators.trajectory import split_first
    from tracewright.streaming.place import shared_dir

    s = split_first(X.steps(spark, d), "episode_id", 5)
    counts = files.write_splits(s.where("split = 'train'"), s.where("split = 'test'"), shared_dir(spark))
    return spark.createDataFrame([(k, v) for k, v in counts.items()], "split string, n long")
