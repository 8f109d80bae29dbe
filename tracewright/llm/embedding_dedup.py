"""Embedding near-duplicates by int8 tile products with exact error bounds.

Equal vectors form one class first. Unit vectors are quantised to int8 with a scale of their own; tiles of classes
are multiplied as int8 values held in float32, in which sums of products stay exact. With u = s*q + e, the
product of two unit vectors differs from s*t*(q.r) by at most |e_u| + |e_v| + |e_u||e_v|, so only pairs within that
bound of the threshold are recomputed in double precision, from the vectors as stored. A tile returns links as a
count for each class and a spanning forest, never as pairs.

Blocks hold vectors that are near each other (in order of the signs of fixed projections) and lie as files in the
folder that driver and executors share: a head with centre and angular radius of each strip of 512 vectors, int8
values, vectors as stored. No vector is shuffled to its tiles. A task reads both heads of a tile first, rules out
the strips that can't hold a link, and reads only the int8 values of the others; stored vectors are read for strips
with pairs in doubt.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_map, join_totals, opened, shared_dir, sliced, written
from tracewright.llm.components import connected_components, join_roots

#: Vectors of a strip, the unit in which products are ruled out.
STRIP = 512
#: Bits of a vector's place: at most 65,536 places for each length of vectors, the bound of what the driver counts.
BITS = 16
#: Bytes of double precision values that a block may hold.
BLOCK_BYTES = 32 << 20


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and the norms of what quantising lost, of unit rows."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    q = np.rint(x / scale[:, None])
    lost = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, lost


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def strips(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and largest angle to it of each strip of unit rows."""
    centres = np.array([x[k : k + STRIP].sum(axis=0) for k in range(0, len(x), STRIP)])
    norms = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    centres = np.where(norms > 1e-9, centres / np.maximum(norms, 1e-9), np.eye(1, x.shape[1]))
    least = [(x[k * STRIP : (k + 1) * STRIP] @ c).min() for k, c in enumerate(centres)]
    return centres, np.arccos(np.clip(least, -1, 1))


class Block:
    """A block's parts by strip: from arrays, or read from its file as they are asked for."""

    def __init__(self, n: int, size: int, kind: str, read) -> None:
        self.n, self.size, self.kind, self.read = n, size, np.dtype(kind), read
        self.n_strips = -(-n // STRIP)
        self.head = 8 * (self.n_strips * (size + 1) + 2 * n)
        parts = np.split(np.frombuffer(read(0, self.head), "<f8"), np.cumsum([self.n_strips * size, self.n_strips, n]))
        self.centres, self.radii, self.scale, self.lost = parts[0].reshape(-1, size), *parts[1:]
        self.held: dict[int, np.ndarray] = {}
        self.units: dict[int, np.ndarray] = {}

    @staticmethod
    def bytes_of(stored: np.ndarray) -> bytes:
        x = unit(stored.astype(np.float64))
        q, scale, lost = quantised(x)
        return b"".join(a.astype("<f8").tobytes() for a in (*strips(x), scale, lost)) + q.tobytes() + stored.tobytes()

    @classmethod
    def of(cls, stored: np.ndarray) -> "Block":
        data = cls.bytes_of(stored)
        return cls(*stored.shape, stored.dtype.str, lambda at, n: data[at : at + n])

    @classmethod
    def opened(cls, name: str, n: int, size: int, kind: str) -> "Block":
        store, path = opened(name)

        def read(at: int, n: int) -> bytes:
            with store.open_input_file(path) as f:
                f.seek(at)
                return f.read(n)

        return cls(n, size, kind, read)

    def need(self, wanted: np.ndarray) -> None:
        """Reads the int8 values from the first to the last of these strips at once."""
        wanted = [s for s in wanted.tolist() if s not in self.held]
        if wanted:
            low, high = wanted[0], wanted[-1] + 1
            rows = min(high * STRIP, self.n) - low * STRIP
            q = np.frombuffer(self.read(self.head + low * STRIP * self.size, rows * self.size), np.int8).reshape(rows, self.size)
            for s in range(low, high):
                self.held[s] = q[(s - low) * STRIP : (s - low + 1) * STRIP]

    def unit_rows(self, s: int) -> np.ndarray:
        if s not in self.units:
            if len(self.units) >= 16:
                self.units.pop(next(iter(self.units)))
            rows = min((s + 1) * STRIP, self.n) - s * STRIP
            each = self.size * self.kind.itemsize
            raw = self.read(self.head + self.n * self.size + s * STRIP * each, rows * each)
            self.units[s] = unit(np.frombuffer(raw, self.kind).reshape(rows, self.size).astype(np.float64))
        return self.units[s]


def close_pairs(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows of two blocks, a strip with a strip at a time; i < j if ``same``."""
    angle = np.arccos(np.clip(a.centres @ b.centres.T, -1, 1)) - a.radii[:, None] - b.radii[None, :]
    meet = angle <= np.arccos(threshold) + 1e-6
    if same:
        meet = np.triu(meet)
    a.need(np.flatnonzero(meet.any(axis=1)))
    b.need(np.flatnonzero(meet.any(axis=0)))
    kind = np.float32 if a.size <= 1040 else np.float64  # sums of int8 products are exact in either
    for s in np.flatnonzero(meet.any(axis=1)).tolist():
        fa, u = a.held[s].astype(kind), s * STRIP
        sa, ea = a.scale[u : u + STRIP], a.lost[u : u + STRIP]
        for t in np.flatnonzero(meet[s]).tolist():
            v = t * STRIP
            sb, eb = b.scale[v : v + STRIP], b.lost[v : v + STRIP]
            dot = fa @ b.held[t].astype(kind).T
            loose = ea + eb.max() + ea * eb.max() + 1e-9
            i, j = np.nonzero(dot >= ((threshold - loose) / (sa * sb.max()) * (1 - 1e-6)).astype(kind)[:, None])
            if same and s == t:
                i, j = i[i < j], j[i < j]
            near = dot[i, j].astype(np.float64) * sa[i] * sb[j]
            bound = ea[i] + eb[j] + ea[i] * eb[j] + 1e-9
            linked = near >= threshold + bound
            doubt = np.flatnonzero((near >= threshold - bound) & ~linked)
            if len(doubt):
                x, y = a.unit_rows(s)[i[doubt]], b.unit_rows(t)[j[doubt]]
                linked[doubt] = np.einsum("ij,ij->i", x, y) >= threshold
            if linked.any():
                yield i[linked] + u, j[linked] + v


def tile(a: Block, b: Block, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float, same: bool, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with links (those of ``b`` after those of ``a``), their numbers of linked rows, their trees' least places."""
    n = 0 if same else a.n
    links, root, held = np.zeros(n + b.n), np.arange(n + b.n), []
    weight = weight_a if same else np.concatenate([weight_a, weight_b])
    for i, j in close_pairs(a, b, threshold, same):
        j = j + n
        links += np.bincount(i, weight[j], len(links)) + np.bincount(j, weight[i], len(links))
        held.append((i, j))
        if sum(len(x) for x, _ in held) >= most:
            join_roots(root, *map(np.concatenate, zip(*held)))
            held = []
    if held:
        join_roots(root, *map(np.concatenate, zip(*held)))
    hit = np.flatnonzero(links)
    return hit, links[hit].astype(np.int64), root[hit]


def _packed(kind: str):
    """Valid vectors as bytes with their digest, null for others; -0 becomes 0."""

    def run(batch: pa.RecordBatch) -> dict:
        vecs, digests = [], []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if y is None else y for y in v or ()], kind)
            ok = len(x) and np.isfinite(x).all() and x.any()
            vecs.append((x + np.zeros(1, kind)).tobytes() if ok else None)
            digests.append(xxhash.xxh3_128_digest(vecs[-1]) if ok else None)
        return {"vec_id": batch.column(0), "vec": vecs, "digest": digests}

    return run


def _placed(kind: str, seed: int = 7):
    """A place in a fixed order for each vector: the signs of fixed projections, read as a Gray code."""

    def run(batch: pa.RecordBatch) -> dict:
        vecs = pd.Series(batch.column(3).to_pylist(), dtype=object)
        place = np.zeros(len(vecs), np.int64)
        for rows in vecs.groupby(vecs.str.len()).groups.values():
            x = unit(np.stack([np.frombuffer(v, kind) for v in vecs[rows]]).astype(np.float64))
            signs = (x @ np.random.default_rng(seed).standard_normal((x.shape[1], BITS)) > 0).astype(np.int64)
            place[rows] = (np.bitwise_xor.accumulate(signs, axis=1) @ (1 << np.arange(BITS)[::-1])) + (x.shape[1] << BITS)
        return {"digest": batch.column(0), "ident": batch.column(1), "weight": batch.column(2), "vec": batch.column(3), "place": place}

    return run


CLASS = "digest binary, ident long, weight long, vec binary, place long"


def _dealt(counts: list[tuple[int, int]], block: int, least: int):
    """Block numbers by place: vectors of one length share blocks, and a place with many rows is split by a hash.

    Returns the function that deals a batch out and the last block of each length.
    """
    starts, last, blocks = {}, {}, 0
    total = sum(c for _, c in counts)
    for size in sorted({p >> BITS for p, _ in counts}):
        mine = sorted(x for x in counts if x[0] >> BITS == size)
        rows = max(1, min(block, -(-total // least), max(STRIP, BLOCK_BYTES // (8 * size))))
        used = 0
        for place, c in mine:
            starts[place] = (blocks, used, c, rows)
            used += c
        blocks += -(-used // rows)
        last[size] = blocks - 1

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for digest, place in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            first, before, c, rows = starts[place]
            out.append(first + (before + int.from_bytes(digest[:6], "little") % c) // rows)
        return {f: batch.column(k) for k, f in enumerate(("digest", "ident", "weight", "vec", "place"))} | {"b": out}

    return run, last


NODE = "node long, b long, digest binary, ident long, weight long, file string, n int, size int, last long"


def _filed(folder: str, kind: str, last: dict[int, int]):
    """Rows in order of block, place and digest: writes a file for each block and gives each row its number.

    A block's first row has the file. A task that runs again writes files of its own; only those of finished tasks
    are in the table.
    """

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            b, n = held[0][5], len(held)
            stored = np.stack([np.frombuffer(r[3], kind) for r in held])
            name = f"{folder}/{uuid.uuid4().hex}.block"
            store, path = opened(name)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(Block.bytes_of(stored))
            digests, idents, weights = ([r[k] for r in held] for k in range(3))
            size = stored.shape[1]
            columns = [[(b << 32) + k for k in range(n)], [b] * n, digests, idents, weights, [name] + [None] * (n - 1), [n] * n, [size] * n, [last[size]] * n]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in (part for whole in batches for part in sliced(whole)):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[5] != held[0][5]:
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return run


def _multiplied(threshold: float, kind: str):
    """Rows (i, j, size, both files, sizes and weights) to (node, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            for i, j, size, file_i, n_i, weight_i, file_j, n_j, weight_j in zip(*(c.to_pylist() for c in batch.columns)):
                if at != file_i:
                    at, block = file_i, Block.opened(file_i, n_i, size, kind)
                other = block if i == j else Block.opened(file_j, n_j, size, kind)
                w = [np.ones(n) if x is None else np.frombuffer(x, "<i8").astype(np.float64) for n, x in ((n_i, weight_i), (n_j, weight_j))]
                hit, links, root = tile(block, other, *w, threshold, i == j)
                nodes = np.arange(n_i) + (i << 32)
                if i != j:
                    nodes = np.concatenate([nodes, np.arange(n_j) + (j << 32)])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links), pa.array(nodes[root])], names=["node", "links", "root"])

    return run


def _weights(batch: pa.RecordBatch) -> dict:
    """A block's weights in order as bytes; null if all are 1."""
    out = []
    for rows in batch.column(4).to_pylist():
        w = np.array([r["weight"] for r in sorted(rows, key=lambda r: r["node"])], "<i8")
        out.append(None if (w == 1).all() else w.tobytes())
    return {n: batch.column(k) for k, n in enumerate(("b", "file", "n", "size"))} | {"weights": out, "last": batch.column(5)}


def embedding_dedup(
    vectors: DataFrame,
    threshold: float = 0.95,
    ident: str = "vec_id",
    embedding: str = "embedding",
    block: int = 65_536,
    least_blocks: int = 12,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Links are pairs of rows with a cosine of at least ``threshold`` in double precision; vectors of different lengths
    are never linked. Null, empty and zero vectors and those with null or non-finite components link with nothing;
    each is its own component. Equal vectors (equal 128-bit digests) are one class: a class counts its other rows as
    links. component_id is the smallest id reachable; null ids count for nothing there, so it is null where no row
    reached has an id, and a row without an id is never kept. Rows that repeat an id are rows of their own: they
    link by their vectors alone, and each has its own component. Other columns are ignored; an empty table stays
    empty. Products grow with the square of the number of different vectors, less the strips that centres and radii
    rule out; what is read for them does so too, by an int8 value in place of each component and n / ``block``
    times. The shuffle grows with the input, except that a tile of a block with repeated vectors carries that block's
    weights, 8 bytes a vector. A class or component with very many rows is met in many tasks.
    """
    element = dict(vectors.dtypes)[embedding]
    kind = "<f4" if element == "array<float>" else "<f8"
    slim = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"))
    rows = arrow_map(slim, _packed(kind), "vec_id long, vec binary, digest binary")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("ident"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = written(arrow_map(classes.select("digest", "ident", "weight", "vec"), _placed(kind), CLASS))
    deal, last = _dealt([(r[0], r[1]) for r in classes.groupBy("place").count().collect()], block, least_blocks)
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = arrow_map(classes, deal, f"{CLASS}, b long").repartition(n, "b").sortWithinPartitions("b", "place", "digest")
    nodes = written(dealt.mapInArrow(_filed(shared_dir(spark), kind, last), NODE))
    heavy = nodes.where("weight > 1").select("b").distinct()
    listed = nodes.join(heavy, "b", "left_semi").groupBy("b").agg(F.collect_list(F.struct("node", "weight")).alias("rows"))
    manifest = nodes.where("file is not null").select("b", "file", "n", "size", "last").join(listed, "b", "left")
    manifest = arrow_map(manifest.select("b", "file", "n", "size", F.coalesce("rows", F.expr("cast(array() as array<struct<node:bigint,weight:bigint>>)")).alias("rows"), "last"), _weights, "b long, file string, n int, size int, weights binary, last long")
    manifest = written(manifest)
    side = lambda s, *more: manifest.select(F.col("b").alias(s), *more, F.col("file").alias(f"file_{s}"), F.col("n").alias(f"n_{s}"), F.col("weights").alias(f"weights_{s}"))
    left = side("i", "size", F.explode(F.sequence("b", "last")).alias("j"))
    run = max(1, (max(last.values(), default=0) + 1) // 64)  # tiles of a block that one task takes
    tiles = left.join(side("j"), "j").select("i", "j", "size", "file_i", "n_i", "weights_i", "file_j", "n_j", "weights_j")
    tiles = tiles.repartition(n, "i", F.floor(F.col("j") / run)).sortWithinPartitions("i", "j")
    found = written(tiles.mapInArrow(_multiplied(threshold, kind), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select("node", "root"))
    of_class = nodes.select("digest", "node", "ident", "weight").join(links, "node", "left").join(components, "node", "left")
    of_class = of_class.select("digest", "ident", "weight", F.coalesce("component", "node").alias("component"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_class = written(of_class)
    total = nodes.agg(F.sum("weight")).first()[0] or 0
    least = written(of_class.groupBy("component").agg(F.min("ident").alias("component_id"), F.count("*").alias("n")))
    of_class = join_totals(of_class.drop("ident"), least, "component", total)
    of_class = written(of_class.select("digest", "weight", "n_links", "component_id"))
    # Rows without a valid vector meet a row of their own, which is always taken for hot.
    invalid = spark.range(1).select(F.expr("X''").alias("digest"), F.lit(1 << 62).alias("weight"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    rows = rows.select("vec_id", F.coalesce("digest", F.expr("X''")).alias("digest"))
    out = join_totals(rows, of_class.unionByName(invalid), "digest", total, "weight")
    out = out.select("vec_id", "n_links", F.when(F.length("digest") > 0, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
