"""The queries of the corpus operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), window=2048)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.line_dedup import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_key=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import zlib

    from tracewright.llm.common import arrow_map
    from tracewright.llm.tiff import features, tiff_encoded, tiff_pages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = tiff_encoded(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    # Its own files: as large as a text can be.
    pages = tiff_pages(stored, most_bytes=(1 << 31) - 1).select("doc_id", "n_bytes", "pixels", "media")

    def digests(batch):
        pixels, media = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        return {
            "doc_id": batch.column(0),
            "n_bytes": batch.column(1),
            "payload_bytes": [len(p) for p in pixels],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in pixels],
            "tail_crc32": [zlib.crc32(p[-64:]) for p in pixels],
            "media_bytes": [len(m) for m in media],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            "feature": [features(p) for p in pixels],
        }

    return arrow_map(pages, digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.toxicity import fit_toxicity, held_out, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = toxicity(docs, model).withColumnRenamed("toxicity", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.url_filter import RULES, url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.common import written
    from tracewright.llm.mixing import mixed, text_quality, word_count

    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count("text").alias("words"), text_quality("text").alias("quality"), F.md5("text").alias("tie")))
    out = mixed(sized, F.col("words"), quality=F.col("quality"), tie=F.col("tie"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.decontamination import decontaminated

    items = F.array_join(F.array_sort("items"), ",")
    out = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    out = out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.conversation_repair import damaged, repaired

    rows = table(spark, sf_dir, "conversations")
    out = repaired(damaged(rows), rows.select("conv_id"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.periodic_runs import periodic_runs, with_periodic_tails

    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    # The greatest length comes first, of those the least start, of those the least period.
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    out = found.withColumn("best", F.array_min(order))
    listed = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    length, period = -F.col("best.l"), F.col("best.p")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_packing, op3_line_dedup, op4_tiff, op5_toxicity, op6_substring_dedup, op7_minhash, op8_url_filter, op9_mixing, op10_embedding_dedup, op11_decontamination, op12_conversation_repair, op13_periodic_runs)}

_URL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
front AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1, 's') AS front FROM cut),
parts AS (
  SELECT page_id, translate(regexp_extract(front, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(front, '^[^/]*(.*)$', 1, 's') AS path
  FROM front),
rules(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
met AS (
  SELECT page_id, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM parts p LEFT JOIN met m ON p.page_id = m.page_id AND m.k = 1
"""

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS tie, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         greatest(coalesce(1 - length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.0), 1e-6) AS q
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / q AS k FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sources),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS bound FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY bound / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN weight * level >= bound THEN bound
         ELSE weight * max(level) FILTER (WHERE weight * level < bound) OVER () END::DOUBLE AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS e FROM targets),
blocks AS (SELECT source, k, doc_id, tie, size, sum(size) AS block FROM keyed GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(block) OVER (PARTITION BY source ORDER BY k, doc_id, tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM blocks)
SELECT d.doc_id, d.size, t.source_size, t.target, (t.e * d.size + CASE WHEN p.place + p.block / 2.0 <= t.target - t.e * t.source_size THEN d.size ELSE 0 END)::BIGINT AS taken
FROM keyed d JOIN epochs t ON d.source IS NOT DISTINCT FROM t.source
JOIN placed p ON p.source IS NOT DISTINCT FROM d.source AND p.k = d.k AND p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.tie = d.tie AND p.size = d.size
"""

_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keys AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keys WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keys LEFT JOIN common c ON keys.k = c.k GROUP BY doc_id
"""

_WINDOWS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
windows AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(*) > 1),
late AS (SELECT r, i FROM windows JOIN firsts USING (k) WHERE doc_id > first),
gone AS (SELECT DISTINCT r, i + j AS p FROM late, generate_series(0, 49) g(j)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

_COSINES = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
valid AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM sides GROUP BY 1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""

#: CRC-32 of short ASCII texts: a table of its 256 steps, then a fold over the bytes.
_CRC = r"""
steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS b)))"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END"


_RUNS = rf"""
WITH {_CRC},
crcs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, steps),
sized AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM crcs),
cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM cut),
words AS (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
best AS (SELECT DISTINCT ON (r) r, start, length, period FROM runs ORDER BY r, length DESC, start, period),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

#: A fold over rows in order: the best (cost, audit, lines) of each state, a state being the initial of what came last.
_REPAIR = rf"""
WITH RECURSIVE {_CRC},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
ways AS (SELECT *, {_crc("place")} % 20 AS way FROM given, steps),
hit AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
         CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy
  FROM ways WHERE way <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS t FROM hit),
faults AS (SELECT *, role[1:1] AS x, CASE WHEN t = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN t[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
adds(state, role) AS (VALUES ('', 'user'), ('s', 'user'), ('u', 'assistant'), ('a', 'user')),
runs AS (
  SELECT state, state AS after, '' AS audit, '' AS lines, 0 AS cost FROM adds
  UNION ALL SELECT state, role[1:1], 'I', role || ':' || chr(10), 2 FROM adds
  UNION ALL SELECT x.state, y.role[1:1], 'II', x.role || ':' || chr(10) || y.role || ':' || chr(10), 4 FROM adds x JOIN adds y ON y.state = x.role[1:1]),
done AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0, 'audit': '', 'lines': ''}} AS best FROM facts
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT f.conv_id, f.i, CASE edit WHEN 'D' THEN r.after WHEN 'K' THEN f.x ELSE a.role[1:1] END AS state,
           {{'cost': d.best.cost + r.cost + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
             'audit': d.best.audit || r.audit || edit,
             'lines': d.best.lines || r.lines || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE a.role || ':' || f.text || chr(10) END}} AS best
    FROM done d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN runs r ON r.state = d.state JOIN adds a ON a.state = r.after, (VALUES ('D'), ('K'), ('R')) e(edit)
    WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR f.x <> '' AND r.after || f.x IN ('s', 'u', 'su', 'au', 'ua')))
  GROUP BY conv_id, i, state),
ended AS (
  SELECT d.conv_id, min({{'cost': d.best.cost + r.cost, 'audit': d.best.audit || r.audit, 'lines': d.best.lines || r.lines}}) AS best
  FROM done d JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.i JOIN runs r ON r.state = d.state WHERE r.after IN ('', 'a') GROUP BY d.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.lines[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_LEAKS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_starts AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM item_starts),
widths AS (SELECT DISTINCT k FROM item_windows),
starts AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, widths WHERE len(w) >= k),
windows AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM starts),
met AS (SELECT r, i, windows.k, item_id FROM windows JOIN item_windows ON windows.k = item_windows.k AND windows.t = item_windows.t),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM met) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS t FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""

ORACLE_SQL = {
    "op3_line_dedup": _LINES,
    "op6_substring_dedup": _WINDOWS,
    "op7_minhash": _NEAR,
    "op8_url_filter": _URL,
    "op9_mixing": _MIX,
    "op10_embedding_dedup": _COSINES,
    "op11_decontamination": _LEAKS,
    "op12_conversation_repair": _REPAIR,
    "op13_periodic_runs": _RUNS,
}
