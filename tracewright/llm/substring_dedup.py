"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words of a document; its minimiser is the least hash of the ``gram``-word runs in it.
Consecutive windows that share a minimiser travel as one string, a super-k-mer, to the minimiser's bucket. Equal
windows have equal minimisers, so minimisers of a single document are left out before any text moves. Equal
super-k-mers are combined before the shuffle, to the least document that holds them; in a bucket the windows of all
different ones are sorted by a 128-bit hash of their words, which finds each window's least document. A minimiser
with very many different super-k-mers is split: its windows go out one by one, as hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_map, sliced, texts, written
from tracewright.llm.shingles import scrambled, word_hashes

P1, P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MEMBER = "m long, doc_id long, rid long, start int, windows int, h1 long, h2 long, packed binary"
RUNS = "array<struct<a:int,b:int>>"


def _powers(p: int, n: int, kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(kept.get(p, ((),))[0]) < n:
        size = max(4096, 2 * n)
        one = np.ones(1, np.uint64)
        kept[p] = tuple(np.cumprod(np.concatenate([one, np.full(size, q, np.uint64)])) for q in (p, pow(p, -1, 1 << 64)))
    return kept[p]


def run_hashes(h: np.ndarray, k: int, p: int = P1) -> np.ndarray:
    """A hash of each k consecutive values, from running sums."""
    n = len(h)
    up, down = _powers(p, n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    return scrambled((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    done = 1
    while 2 * done <= k:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = k - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def super_kmers(h: np.ndarray, window: int, gram: int, longest: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each; very long ones come in parts."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(run_hashes(h, gram), window - gram + 1)
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(new, len(least)))
    parts = -(-size // longest)
    which = np.repeat(np.arange(len(new)), parts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = new[which] + part * longest
    return least[start].view(np.int64), start, np.minimum(longest, new[which] + size[which] - start)


def _first_last(window: int, gram: int):
    """Each minimiser of a batch with its least and greatest document."""

    def run(batch: pa.RecordBatch) -> dict:
        found, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(2))):
            words = text.split()
            if len(words) >= window:
                m = np.unique(super_kmers(word_hashes(words), window, gram)[0])
                found.append(m)
                docs.append(np.full(len(m), doc_id))
        m, d = np.concatenate(found), np.concatenate(docs)
        order = np.lexsort((d, m))
        m, d = m[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, int)
        return {"m": m[first], "a": d[first], "z": d[np.append(first[1:], len(m)) - 1] if len(m) else d}

    return run


def _member(m: int, doc_id: int, rid: int, start: int, windows: int, words: list[bytes], window: int) -> tuple:
    packed = b" ".join(words[start : start + windows + window - 1])
    h = np.frombuffer(xxhash.xxh3_128_digest(packed), "<i8")
    return m, doc_id, rid, start, windows, int(h[0]), int(h[1]), packed


def _columns(rows: list[tuple], names: list[str]) -> dict:
    return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


NAMES = ["m", "doc_id", "rid", "start", "windows", "h1", "h2", "packed"]


def _members(docs: DataFrame, window: int, gram: int, broadcast_keys: int) -> DataFrame:
    """The super-k-mers whose minimiser is in more than one document, with their strings."""
    seen = arrow_map(docs, _first_last(window, gram), "m long, a long, z long").groupBy("m").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    shared = written(seen.where("a < z").select("m"))
    if shared.count() <= broadcast_keys:  # eight bytes each
        keys = np.sort(np.array([r.m for r in shared.toLocalIterator()], np.int64))
        sent = docs.sparkSession.sparkContext.broadcast(keys)

        def pack(batch: pa.RecordBatch) -> dict:
            rows, keys = [], sent.value
            for doc_id, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                words = text.split()
                if len(words) < window or not len(keys):
                    continue
                m, start, windows = super_kmers(word_hashes(words), window, gram)
                hit = keys[np.minimum(np.searchsorted(keys, m), len(keys) - 1)] == m
                rows += [_member(*x, words, window) for x in zip(m[hit].tolist(), *[[v] * int(hit.sum()) for v in (doc_id, rid)], start[hit].tolist(), windows[hit].tolist())]
            return _columns(rows, NAMES)

        return written(arrow_map(docs, pack, MEMBER))

    # Beyond: the places of super-k-mers meet the shared minimisers by a join, then their documents' texts.
    def places(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc_id, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            m, start, windows = super_kmers(word_hashes(text.split()), window, gram)
            rows += [(x, doc_id, rid, s, w) for x, s, w in zip(m.tolist(), start.tolist(), windows.tolist())]
        return _columns(rows, NAMES[:5])

    found = arrow_map(docs, places, "m long, doc_id long, rid long, start int, windows int").distinct().join(shared, "m")
    found = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("m", "start", "windows")).alias("places"))

    def pack_places(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc_id, rid, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist()):
            words = text.split()
            rows += [_member(p["m"], doc_id, rid, p["start"], p["windows"], words, window) for p in at]
        return _columns(rows, NAMES)

    return written(arrow_map(docs.join(found, ["doc_id", "rid"]).select("doc_id", "rid", "text", "places"), pack_places, MEMBER))


def _window_hashes(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of each string, and the strings' numbers of windows."""
    a, b, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
    for s in packed:
        h = word_hashes(s.split(b" "))
        a.append(run_hashes(h, window, P1))
        b.append(run_hashes(h, window, P2))
        n.append(len(a[-1]))
    return np.concatenate(a), np.concatenate(b), np.array(n, np.int64)


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]


def _bucket(window: int, most: int):
    """Rows sorted by minimiser; whole buckets are taken together, and their windows sorted."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        m, first, h1, h2, packed = zip(*rows)
        a, b, n = _window_hashes(packed, window)
        owner = np.repeat(np.arange(len(rows)), n)
        doc = np.array(first, np.int64)[owner]
        order = np.lexsort((doc, b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(order) else np.zeros(0, bool)
        least = np.empty_like(doc)
        least[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else doc
        earlier = np.split(least < doc, np.cumsum(n)[:-1])
        return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(first, pa.int64()), pa.array([_runs(e) for e in earlier], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["h1", "h2", "first", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in (part for whole in batches for part in sliced(whole)):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= most and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _earlier(strings: DataFrame, window: int, hot: int) -> DataFrame:
    """(h1, h2, first, runs): each different super-k-mer's least document and its runs of windows that an earlier one holds."""
    sizes = strings.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    crowded = written(sizes.select("m"))
    usual = strings if crowded.isEmpty() else strings.join(crowded, "m", "left_anti")
    columns = ["m", "first", "h1", "h2", "packed"]
    n = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = usual.select(columns).repartition(n, "m").sortWithinPartitions("m")
    out = usual.mapInArrow(_bucket(window, 2000), f"h1 long, h2 long, first long, runs {RUNS}")
    if crowded.isEmpty():
        return out

    def single(batch: pa.RecordBatch) -> dict:
        a, b, n = _window_hashes(batch.column(4).to_pylist(), window)
        owner = np.repeat(np.arange(batch.num_rows), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        taken = batch.take(pa.array(owner, pa.int64()))
        return {"h1": taken.column(2), "h2": taken.column(3), "first": taken.column(1), "place": place, "a": a.view(np.int64), "b": b.view(np.int64)}

    windows = written(arrow_map(strings.join(crowded, "m").select(columns), single, "h1 long, h2 long, first long, place int, a long, b long"))
    least = windows.groupBy("a", "b").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("a", "b", "least")
    hit = windows.join(least, ["a", "b"]).where("least < first")
    hit = hit.groupBy("h1", "h2", "first").agg(F.collect_list(F.struct(F.col("place").alias("a"), (F.col("place") + 1).alias("b"))).alias("runs"))
    rest = strings.join(crowded, "m").select("h1", "h2", "first").join(hit.select("h1", "h2", "runs"), ["h1", "h2"], "left")
    return out.unionByName(rest.select("h1", "h2", "first", F.coalesce("runs", F.expr(f"cast(array() as {RUNS})")).alias("runs")))


def substring_dedup(
    docs: DataFrame,
    window: int = 50,
    gram: int = 8,
    ident: str = "doc_id",
    text: str = "text",
    broadcast_keys: int = 2_000_000,
    hot: int = 5000,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs``.

    A word goes if it lies in a window whose words also start in a row of a smaller id; windows are judged on the
    input. Words are what ASCII white space separates; the kept ones are joined by one space. Null and empty texts
    have none. Rows that share an id don't remove each other's words; a null id counts as the greatest long, 2^63 - 1,
    here, and comes back as null. Other columns are ignored; an empty table stays empty. ``docs`` is read three times.
    """
    slim = docs.select(F.col(ident).cast("long").alias("ident"), F.coalesce(F.col(ident).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(F.col(text)).alias("rid"), F.col(text).cast("string").alias("text"))
    members = _members(slim.drop("ident"), window, gram, broadcast_keys)
    strings = members.groupBy("m", "h1", "h2", "packed").agg(F.min("doc_id").alias("first"))
    earlier = written(_earlier(written(strings), window, hot))
    spans = members.select("doc_id", "rid", "start", "windows", "h1", "h2").join(earlier, ["h1", "h2"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    runs = F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("runs"))
    spans = spans.withColumn("runs", runs).where(F.size("runs") > 0)
    span = F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (window - 1)).alias("b")))
    spans = written(spans.select("doc_id", "rid", span.alias("spans")).groupBy("doc_id", "rid").agg(F.flatten(F.collect_set("spans")).alias("spans")))
    marked = slim.join(spans, ["doc_id", "rid"], "left").select("ident", "text", "spans")

    def cut(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        for value, gone in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
            words = value.split()
            n_words.append(len(words))
            if gone:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, [s["a"] for s in gone], 1)
                np.add.at(edges, [s["b"] for s in gone], -1)
                stays = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                words = [words[i] for i in stays.tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return {"doc_id": batch.column(0), "n_words": n_words, "n_removed": n_removed, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept_text": [k.decode("utf-8", "replace") for k in kept]}

    return arrow_map(marked, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
