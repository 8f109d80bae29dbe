"""Queries of joins, set operations, batch algebra, sampling and paging."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import batch as B
from tracewright.operators import joins as J
from tracewright.operators.order import latest, numbered, numbered_by_hash, seeded
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X

R = "WITH " + X.ROLLOUTS


@query("SELECT c.c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(o.kind, 'none') AS kind FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS kind FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) o ON c.c_custkey = o.o_custkey")
def join_precond(spark, d):
    o = X.read(spark, d, "orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.min("o_orderpriority").alias("kind"))
    return J.lookup(X.read(spark, d, "customer").select("c_custkey"), o, "c_custkey", n_orders=0, kind="none")


@query("""WITH names AS (SELECT DISTINCT p_name AS name, upper(p_name) AS app FROM part), keys AS (SELECT n_nationkey, name AS full_name, substr(name, 1, 1 + n_nationkey % 12) AS key FROM nation JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM names) t ON t.i = n_nationkey)
SELECT n_nationkey, key, coalesce((SELECT app FROM names WHERE name = key), (SELECT CASE WHEN count(*) = 1 THEN min(app) END FROM names WHERE starts_with(name, key))) AS app FROM keys""")
def join_app_map(spark, d):
    names = X.read(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("app", F.upper("name"))
    nation = X.read(spark, d, "nation")
    first = names.select("name").orderBy("name").limit(nation.count())  # a name for each nation, by a top-n
    listed = first.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("n_nationkey"))
    keys = nation.join(listed, "n_nationkey").select("n_nationkey", F.expr("substr(name, 1, 1 + n_nationkey % 12)").alias("key"))
    return J.by_prefix(keys, names, "key", "name", "app").select("n_nationkey", "key", "app")


@query("SELECT c_custkey, CASE WHEN n_nationkey < 20 THEN n_name ELSE 'unknown' END AS category FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_category(spark, d):
    n = X.read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("category"))
    return J.lookup(X.read(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", category="unknown").select("c_custkey", "category")


@query("SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON p.p_retailprice BETWEEN s.s_acctbal AND s.s_acctbal + 40")
def join_range(spark, d):
    s = X.read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 40).alias("high"))
    return J.range_join(X.read(spark, d, "part").select("p_partkey", "p_retailprice"), s, "p_retailprice", "low", "high", 5).select("p_partkey", "s_suppkey")


@query(f"WITH {X.BOXES} SELECT l_orderkey, l_linenumber, l_partkey, px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AS hit FROM boxes")
def join_point_in_box(spark, d):
    from tracewright.functions.geometry import point_in_box

    b = X.boxes(spark, d)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", point_in_box(F.col("px"), F.col("py"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("hit"))


@query(f"{R} SELECT a.row_id, a.score, a.acc, b.k, a.score IS NOT DISTINCT FROM CASE WHEN a.row_id % 10 = 0 THEN -1 ELSE b.score END AS same FROM rollouts a JOIN rollouts b ON a.row_id = b.row_id")
def zip_union(spark, d):
    r = X.rollouts(spark, d)
    right = r.select("row_id", F.when(F.col("row_id") % 10 == 0, -1.0).otherwise(F.col("score")).alias("score"), "k")
    return B.zipped(r.select("row_id", "score", "acc"), right, "row_id").select("row_id", "score", "acc", "k", "same")


@query(f"{R} SELECT row_id, CASE WHEN contains(data_source, 'c') THEN score * 2 ELSE score - 1 END AS teacher FROM rollouts")
def join_teacher_route(spark, d):
    return X.rollouts(spark, d).select("row_id", F.when(F.contains("data_source", F.lit("c")), F.col("score") * 2).otherwise(F.col("score") - 1).alias("teacher"))


@query(f"WITH {X.STEPS} SELECT c.c_custkey, coalesce(array_to_string(q.qs, '|'), '') AS earlier FROM customer c LEFT JOIN (SELECT episode_id, list(action ORDER BY step) AS qs FROM steps WHERE role = 'user' GROUP BY 1) q ON q.episode_id = c.c_custkey")
def join_prev_queries(spark, d):
    q = X.steps(spark, d).where("role = 'user'").groupBy(F.col("episode_id").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("step", F.col("action").alias("q")))).alias("qs"))
    return X.read(spark, d, "customer").select("c_custkey").join(q, "c_custkey", "left").select("c_custkey", F.coalesce(F.array_join("qs.q", "|"), F.lit("")).alias("earlier"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_cache(spark, d):
    return X.read(spark, d, "documents").select("doc_id").join(X.read(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT conv_id FROM conversations)")
def semi_task_list(spark, d):
    return X.read(spark, d, "customer").select("c_custkey").join(X.read(spark, d, "conversations").select(F.col("conv_id").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"{R} SELECT row_id, uid FROM (SELECT *, avg(acc) OVER (PARTITION BY uid) AS m, count(*) OVER (PARTITION BY uid) AS n FROM rollouts) WHERE (m > 0.3 AND m < 0.6) OR n = 1")
def semi_kept_uids(spark, d):
    r = X.rollouts(spark, d)
    kept = r.groupBy("uid").agg(F.avg("acc").alias("m"), F.count("*").alias("n")).where("(m > 0.3 AND m < 0.6) OR n = 1")
    return r.join(kept, "uid", "left_semi").select("row_id", "uid")


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS t, unnest(embedding)::DOUBLE AS x FROM embeddings),
dots AS (SELECT a.vec_id AS q, b.vec_id AS v, sum(a.x * b.x) AS dot FROM e a JOIN e b ON a.t = b.t WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id GROUP BY 1, 2),
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
cos AS (SELECT q, v, dot / (nq.n * nv.n) AS c FROM dots JOIN norms nq ON nq.vec_id = q JOIN norms nv ON nv.vec_id = v)
SELECT q AS query_id, v AS vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, v) AS rank FROM cos) WHERE rank <= 5""")
def retrieve_topk(spark, d):
    """The five nearest vectors of each query (ids divisible by 100): queries go out in blocks, a top five leaves each task."""
    from tracewright.operators.retrieval import nearest

    e = X.read(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(e.where("vec_id % 100 = 0"), e, 5)


@query("SELECT doc_id FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id FROM documents WHERE lang = 'fr'")
def union_all(spark, d):
    docs = X.read(spark, d, "documents")
    return docs.where("n_chars > 2000").select("doc_id").unionByName(docs.where("lang = 'fr'").select("doc_id"))


@query(f"WITH {X.STEPS} SELECT device, episode_id, step FROM steps WHERE device = 'mobile' AND step <= 3 UNION ALL SELECT device, episode_id, step FROM steps WHERE device = 'desktop' AND step <= 2")
def union_mix(spark, d):
    s = X.steps(spark, d).select("device", "episode_id", "step")
    return s.where("device = 'mobile' AND step <= 3").unionByName(s.where("device = 'desktop' AND step <= 2"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, line, min(pos) AS pos FROM l WHERE length(line) BETWEEN 1 AND 199 AND contains(lower(line), 'th') GROUP BY 1, 2)
SELECT doc_id, line, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f) WHERE n <= 30""")
def dedup_ordered_set(spark, d):
    lines = X.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    f = lines.where("length(line) BETWEEN 1 AND 199 AND contains(lower(line), 'th')").groupBy("doc_id", "line").agg(F.min("pos").alias("pos"))
    return f.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("n <= 30").select("doc_id", "line", "n")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 0")
def except_filter(spark, d):
    return X.read(spark, d, "documents").select("doc_id").join(X.read(spark, d, "labels").where("quality = 0"), "doc_id", "left_anti")


@query("SELECT c_custkey, rep FROM customer, (VALUES (1), (2), (3)) r(rep)")
def repeat_rows(spark, d):
    return B.repeated(X.read(spark, d, "customer").select("c_custkey"), 3)


@query("SELECT c_custkey, unnest(generate_series(1, c_custkey % 4)) AS rep FROM customer WHERE c_custkey % 4 > 0")
def repeat_by_count(spark, d):
    return B.repeated(X.read(spark, d, "customer").select("c_custkey"), F.col("c_custkey") % 4)


@query("SELECT source, count(*) * 20 AS n FROM documents GROUP BY 1")
def dataset_replicate(spark, d):
    return B.repeated(X.read(spark, d, "documents").select("source"), 20).groupBy("source").agg(F.count("*").alias("n"))


P = "p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


def _placed(spark, d):
    o = X.read(spark, d, "orders").select("o_orderkey")
    return numbered(o, "o_orderkey"), o.count()


@query(f"WITH {P} SELECT o_orderkey, floor(pos / (n / 5))::BIGINT AS chunk, floor(pos / 64)::BIGINT AS part FROM p")
def chunk_split(spark, d):
    p, n = _placed(spark, d)
    return p.select("o_orderkey", B.chunk("pos", n, 5).alias("chunk"), F.floor(F.col("pos") / 64).alias("part"))


@query(f"WITH {P} SELECT pos, o_orderkey FROM p UNION ALL SELECT pos + n, o_orderkey FROM p WHERE pos < (7 - n % 7) % 7")
def pad_to_divisor(spark, d):
    p, n = _placed(spark, d)
    return B.padded(p, "pos", n, 7).select("pos", "o_orderkey")


@query(f"WITH {P} SELECT o_orderkey FROM p")
def unpad(spark, d):
    p, n = _placed(spark, d)
    return B.unpadded(B.padded(p, "pos", n, 7), "pos", n).select("o_orderkey")


@query(f"WITH {P} SELECT o_orderkey, pos FROM p WHERE pos >= 10 AND pos < 900 AND (pos - 10) % 7 = 0")
def slice_rows(spark, d):
    p, _ = _placed(spark, d)
    return B.sliced(p, "pos", 10, 900, 7).select("o_orderkey", "pos")


@query(f"WITH {P} SELECT floor(pos / 8)::BIGINT AS block, string_agg(o_orderkey::VARCHAR, ',' ORDER BY pos) AS ids FROM p GROUP BY 1")
def fold_batch(spark, d):
    p, _ = _placed(spark, d)
    return B.folded(p, "pos", 8, "o_orderkey").select("block", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {P} SELECT pos, o_orderkey FROM p")
def unfold_batch(spark, d):
    p, _ = _placed(spark, d)
    return B.unfolded(B.folded(p, "pos", 8, "o_orderkey"), 8, "o_orderkey")


@query("SELECT vec_id, chunk, round(sum(x), 5) AS total FROM (SELECT vec_id, floor((generate_subscripts(embedding, 1) - 1) / 16)::INT AS chunk, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def unfold_column_chunks(spark, d):
    e = X.tokens(spark, d).select(F.col("id").alias("vec_id"), F.explode(F.sequence(F.lit(0), ((F.size("x") - 1) / 16).cast("int"))).alias("chunk"), "x").where(F.size("x") > 0)
    return e.select("vec_id", "chunk", F.round(F.aggregate(F.slice("x", F.col("chunk") * 16 + 1, 16), F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys, string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS segments FROM customer GROUP BY 1")
def list_dict_transpose(spark, d):
    """Rows to lists by column, one list for each nation: texts of blocks of 1,024 keys are made first, and a nation's texts are joined in order."""
    joined = lambda c: F.when(F.exists(c, lambda v: v.isNotNull()), F.array_join(c, ","))
    blocks = X.read(spark, d, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1024).alias("block")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("r"))
    blocks = blocks.select("c_nationkey", F.struct("block", joined(F.col("r.c_custkey").cast("array<string>")).alias("keys"), joined(F.col("r.c_mktsegment")).alias("segments")).alias("b"))
    rows = blocks.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return rows.select("c_nationkey", joined(F.col("b.keys")).alias("keys"), joined(F.col("b.segments")).alias("segments"))


@query("WITH p AS (SELECT c_custkey, e, row_number() OVER (PARTITION BY e ORDER BY md5(e || ':' || c_custkey), c_custkey) - 1 AS pos FROM customer, (VALUES (1), (2)) t(e)) SELECT e AS epoch, floor(pos / 100)::BIGINT AS batch, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM p GROUP BY 1, 2")
def minibatch_iter(spark, d):
    """Two epochs of shuffled mini-batches, as batch numbers."""
    c = X.read(spark, d, "customer").select("c_custkey")
    each = [numbered_by_hash(c.withColumn("h", seeded("c_custkey", seed=e)), "h", "c_custkey").withColumn("epoch", F.lit(e)) for e in (1, 2)]
    return each[0].unionByName(each[1]).groupBy("epoch", F.floor(F.col("pos") / 100).alias("batch")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def topk_rows(spark, d):
    return X.read(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)


@query("WITH f AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS c FROM documents WHERE contains(lower(text), 'the') AND lang = 'en') SELECT doc_id, ceil(c / 20.0)::BIGINT AS pages FROM f WHERE n BETWEEN 41 AND 60")
def paginate(spark, d):
    """Page 3 of 20 rows each, with the number of pages."""
    f = X.read(spark, d, "documents").where("contains(lower(text), 'the') AND lang = 'en'").select("doc_id")
    pages = -(-f.count() // 20)
    return f.orderBy("doc_id").offset(40).limit(20).withColumn("pages", F.lit(pages).cast("long"))


@query("SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE source = 'src1' AND (contains(lower(text), 'heon') OR contains(lower(lang), 'de')) AND (quality = 1) IS NOT TRUE")
def flt_view(spark, d):
    docs = X.read(spark, d, "documents").join(X.read(spark, d, "labels"), "doc_id", "left")
    found = F.lower("text").contains("heon") | F.lower("lang").contains("de")
    return docs.where((F.col("source") == "src1") & found & ~F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def flt_date_range(spark, d):
    return X.read(spark, d, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def flt_equals(spark, d):
    return X.read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INT AS n_words FROM documents WHERE len(regexp_extract_all(text, '\\S+')) <= 400")
def flt_overlong(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0))
    return X.read(spark, d, "documents").select("doc_id", n.alias("n_words")).where("n_words <= 400")


@query("SELECT c_custkey AS customer, c_name AS title FROM customer")
def prj_select_rename(spark, d):
    return B.required(X.read(spark, d, "customer"), "c_custkey", "c_name").withColumnsRenamed({"c_custkey": "customer", "c_name": "title"})


@query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(count(*) OVER () / 7.0))::BIGINT AS shard FROM documents")
def dist_slice(spark, d):
    docs = X.read(spark, d, "documents").select("doc_id")
    return numbered(docs, "doc_id").select("doc_id", B.shard("pos", docs.count(), 7).alias("shard"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS pos FROM documents")
def shuffle_rows(spark, d):
    docs = X.read(spark, d, "documents").select("doc_id").withColumn("h", seeded("doc_id", seed=7))
    return numbered_by_hash(docs, "h", "doc_id").select("doc_id", "pos")


@query("SELECT doc_id, text FROM (SELECT doc_id, text FROM documents ORDER BY text, doc_id) ORDER BY md5('42:' || doc_id), doc_id LIMIT 10")
def sample_val_log(spark, d):
    return X.read(spark, d, "documents").select("doc_id", "text").orderBy(seeded("doc_id"), "doc_id").limit(10)


@query(f"""{R}, w AS (SELECT row_id, score, greatest(abs(score) ** 2 + 1e-8, 1e-8) AS pow_w, max(score) OVER () AS high, min(score) OVER () AS low FROM rollouts)
SELECT row_id, round(pow_w / sum(pow_w) OVER (), 9) AS pow_p, round(CASE WHEN score IN (high, low) THEN 1.0 ELSE 0.0 END + 1e-8, 9)::DOUBLE AS max_min_w, round(CASE WHEN score = high THEN 0.4 ELSE 0.1 END + 1e-8, 9)::DOUBLE AS max_random_w FROM w""")
def weighted_resample_weights(spark, d):
    r = X.rollouts(spark, d)
    # One row of totals, whatever the number of rows.
    all_ = r.agg(F.sum(B.weights_for_resampling(F.col("score"))).alias("total"), F.min("score").alias("low"), F.max("score").alias("high"))
    r = r.crossJoin(F.broadcast(all_))
    weight = lambda how: F.round(B.weights_for_resampling(F.col("score"), how, low=F.col("low"), high=F.col("high")), 9)
    pow_p = F.round(B.weights_for_resampling(F.col("score")) / F.col("total"), 9)
    return r.select("row_id", pow_p.alias("pow_p"), weight("max_min").alias("max_min_w"), weight("max_random").alias("max_random_w"))


@query(f"""{R}, w AS (SELECT row_id, greatest(abs(score) ** 2 + 1e-8, 1e-8) AS w, md5('42:' || row_id) AS h, (('0x' || substr(md5('draw-42:' || row_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM rollouts),
spans AS (SELECT row_id, sum(w) OVER (ORDER BY h, row_id) - w AS start, sum(w) OVER () AS total FROM w), draws AS (SELECT u * (SELECT max(total) FROM spans) AS point FROM w)
SELECT s.row_id, count(*) AS n FROM draws d ASOF JOIN spans s ON d.point >= s.start GROUP BY 1""")
def weighted_resample(spark, d):
    """A resampled batch: as many rows, heavier ones more often; how often each row was drawn."""
    r = X.rollouts(spark, d).select("row_id", "score").withColumn("w", B.weights_for_resampling(F.col("score")))
    return B.resampled(r, "w", "row_id").groupBy("row_id").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, string_agg(s_name, '|' ORDER BY slot) AS variants FROM (SELECT s_nationkey AS n_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS slot FROM supplier) WHERE slot <= 15 GROUP BY 1")
def csv_variants(spark, d):
    """Up to 15 variants a task, pivoted to columns of fixed names, joined here to compare."""
    s = X.read(spark, d, "supplier").withColumn("slot", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("slot <= 15")
    wide = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).pivot("slot", list(range(1, 16))).agg(F.first("s_name"))
    return wide.select("n_nationkey", F.concat_ws("|", *[F.col(f"`{i}`") for i in range(1, 16)]).alias("variants"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3:' || o_orderkey), o_orderkey) AS n FROM orders) WHERE n = 1")
def join_history_thoughts(spark, d):
    """One entry of each key's buffer, picked by a seeded hash."""
    return latest(X.read(spark, d, "orders").withColumn("h", seeded("o_orderkey", seed=3)), ["o_custkey"], "h", "o_orderkey").select("o_custkey", "o_orderkey")
