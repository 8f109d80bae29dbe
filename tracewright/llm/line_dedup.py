"""Line dedup by a sharded minimal perfect hash over line hashes.

A line's 128-bit hash is counted in documents by a grouped sum. The distinct hashes of lines that more than one
document has (a line that isn't there has a count of one) are dealt to shards by hash; each shard builds a minimal
perfect hash of levels of bits, in which a key sits where it is alone, with compact arrays of fingerprints and counts
in rank order, and writes them to a file in the folder that driver and executors share. Documents then probe the
arrays: the count found there decides, and no line is ever joined. A task takes its documents in portions, probes
shard after shard for all lines of a portion and keeps a bounded number of shards, so one pass over the documents is
enough for an index of any size, and nothing of it goes through the driver but the list of files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import SPACE, numbered_columns, opened, shared_dir, sliced, texts, written

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A count's form and the most it holds.
COUNT, MOST_COUNT = "<u4", 0xFFFFFFFF


def mixed64(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = (a ^ (b + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) * M2
    x ^= x >> np.uint64(29)
    x *= M1
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (two uint64 arrays): 0..n-1 for keys, -1 or any place for others."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        words = np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(axis=1, dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(words)])

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, gamma: float = 1.5) -> "PerfectHash":
        sizes, parts, level = [], [], 0
        while len(a):
            size = max(64, int(len(a) * gamma) + 63 & ~63)
            at = (mixed64(a, b, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            left = ~alone[at]
            a, b, level = a[left], b[left], level + 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        left, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed64(a[left], b[left], level) % np.uint64(size)).astype(np.int64) + base
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at = at[hit]
            word = at >> 6
            octets = self.bits[word[:, None] * 8 + np.arange(8)].view("<u8").ravel()
            below = octets & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            out[left[hit]] = self.ranks[word] + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return out


class LineCounts:
    """A shard: the perfect hash with a fingerprint and a count at each key's place."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray) -> None:
        self.index, self.prints, self.counts = index, prints, counts

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> "LineCounts":
        index = PerfectHash.of(a, b)
        places = index.places(a, b)
        prints, counts = np.zeros(len(a), "<u8"), np.zeros(len(a), COUNT)
        prints[places] = b
        counts[places] = np.minimum(n, MOST_COUNT)
        return cls(index, prints, counts)

    def count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Documents that have each line: 1 for a line that isn't in the index."""
        if not len(self.prints):
            return np.ones(len(a), np.int64)
        at = self.index.places(a, b)
        known = (at >= 0) & (self.prints[at] == b)
        return np.where(known, self.counts[at], 1).astype(np.int64)

    def bytes(self) -> bytes:
        return self.index.bits.tobytes() + self.prints.tobytes() + self.counts.tobytes()

    @classmethod
    def read(cls, name: str, sizes: list[int], n: int) -> "LineCounts":
        store, path = opened(name)
        with store.open_input_file(path) as f:
            data = f.read()
        bits = sum(sizes) // 8
        return cls(PerfectHash(list(sizes), np.frombuffer(data, np.uint8, bits)), np.frombuffer(data, "<u8", n, bits), np.frombuffer(data, COUNT, n, bits + 8 * n))


def line_keys(text: bytes) -> list[bytes]:
    """Each line's key: stripped at both ends, A-Z in lower case (bytes.lower leaves all but A-Z)."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def _counted(min_key: int, most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
            out = pa.RecordBatch.from_pydict({"h1": h[:, 0], "h2": h[:, 1], "n": list(seen.values())}, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())]))
            seen.clear()
            return out

        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update({xxhash.xxh3_128_digest(k) for k in set(line_keys(text)) if _long(k, min_key)})
                if len(seen) >= most:
                    yield flush()
        if seen:
            yield flush()

    return run


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least if least <= 1 else len(key.decode("utf-8", "replace")) >= least


def line_index(docs: DataFrame, text: str = "text", min_key: int = 1, shard_keys: int = 250_000) -> tuple[list[tuple], int]:
    """(shard, file, sizes, keys) of each shard's file, and the number of shards.

    Lines of one document aren't in it. A task that runs again writes files of its own; only those of finished tasks
    are listed.
    """
    spark = docs.sparkSession
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counted(min_key), "h1 long, h2 long, n long")
    repeated = written(parts.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1"))
    shards = max(1, -(-repeated.count() // shard_keys))
    folder = shared_dir(spark)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[c].to_numpy().astype(np.uint64) for c in ("h1", "h2"))
        counts = LineCounts.of(a, b, pdf.n.to_numpy())
        name = f"{folder}/{uuid.uuid4().hex}.lines"
        store, path = opened(name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(counts.bytes())
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "file": [name], "sizes": [counts.index.sizes], "n": [len(a)]})

    made = repeated.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, file string, sizes array<long>, n long")
    return [tuple(r) for r in written(made).collect()], shards


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in (part for whole in batches for part in sliced(whole)):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _probe(files: list[tuple], shards: int, text_at: int, min_docs: int, min_key: int, names: list[str], kinds: pa.Schema, held_bytes: int):
    """Counts of all lines from the shards; lines at the threshold go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = {s: (name, sizes, n) for s, name, sizes, n in files}
        held: dict[int, LineCounts] = {}

        def shard_of(s: int) -> LineCounts:
            if s in held:
                held[s] = held.pop(s)  # the one used last goes last
            else:
                held[s] = LineCounts.read(*listed[s])
                while len(held) > 1 and sum(len(x.prints) for x in held.values()) * 14 > held_bytes:
                    held.pop(next(iter(held)))
            return held[s]

        for portion in _portions(batches, held_bytes):
            keys = [[line_keys(t) for t in texts(part.column(text_at))] for part in portion]
            flat = [k for part in keys for ks in part for k in ks]
            h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat)), "<u8").reshape(-1, 2)
            a, b = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
            shard = a.view(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            counts = np.ones(len(a), np.int64)
            for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(mine) and int(shard[mine[0]]) in listed:
                    counts[mine] = shard_of(int(shard[mine[0]])).count(a[mine], b[mine])
            drop = counts >= min_docs
            if drop.any():
                drop &= np.fromiter((_long(k, min_key) for k in flat), bool, len(flat))
            at = 0
            for part, found in zip(portion, keys):
                gone = []
                for ks in found:
                    gone.append(set(np.flatnonzero(drop[at : at + len(ks)]).tolist()))
                    at += len(ks)
                raw = part.column(text_at)
                kept = [t if not g else b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in g) for t, g in zip(texts(raw), gone)]
                new = {
                    "n_lines": [len(k) for k in found],
                    "n_dropped": [len(g) for g in gone],
                    "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
                    "kept_text": pa.array([x if there or g else None for x, there, g in zip(kept, raw.is_valid().to_pylist(), gone)], pa.binary()).cast(pa.string()),
                }
                cols = {f.name: part.column(i) for i, f in enumerate(part.schema)}
                yield pa.RecordBatch.from_pydict({n: new[n] if n in new else cols[n] for n in names}, schema=kinds)

    return run


def line_dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, min_key: int = 1, shard_keys: int = 250_000, held_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` (all columns) with n_lines, n_dropped, kept_sha256 and kept_text; columns of those names are replaced.

    A line's key is the line stripped of ASCII white space at both ends, A-Z in lower case. Keys of at least
    ``min_key`` code points that occur in at least ``min_docs`` rows (two or more) lose all their lines in every row.
    A null or empty text is one empty line; kept_text stays null where the text is null and is empty where all lines
    went. Repeated rows count as documents of their own. An empty table stays empty. A task holds about
    ``held_bytes`` of documents and as much of the index at a time; a longer text is held whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    new = [("n_lines", "long"), ("n_dropped", "long"), ("kept_sha256", "string"), ("kept_text", "string")]
    docs = docs.drop(*[n for n, _ in new])
    names, docs = docs.columns, numbered_columns(docs)
    at = names.index(text)
    files, shards = line_index(docs, docs.columns[at], min_key, shard_keys)
    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes + new)
    kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    run = _probe(files, shards, at, min_docs, min_key, docs.columns + [n for n, _ in new], kinds, held_bytes)
    return docs.mapInArrow(run, schema).toDF(*names, *[n for n, _ in new])
