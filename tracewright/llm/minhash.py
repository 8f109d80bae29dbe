"""MinHash near-duplicates: universal hash minima, banding, signature verification, confirmed links, components.

Texts with equal shingle sets form one class, which counts once. Classes that share a band are candidates, but a
bucket never emits its pairs. First each member meets one leader: the member that leads most of its buckets. Links
confirmed there make components. Buckets that still hold several components are put together by the largest one they
hold; in such a group, the members outside that component meet all members, at every size in the same way: both sides
are dealt to blocks, and a tile is a block of the ones against a block of the others. Tiles compare signatures first
(96 bytes a member) and return the members that have a near partner, never pairs; only these meet again in their tiles
with their full shingle sets, made again from their texts. There, pairs that links of the tile already join are left
out, so a tile returns a link for each merger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_map, join_totals, sliced, texts, written
from tracewright.llm.components import connected_components
from tracewright.llm.shingles import scrambled, shingle_set

#: Minima a signature has, in bands of ROWS; at a similarity of 0.85 a pair shares no band once in 50 million times.
BANDS, ROWS = 24, 4
#: A pair is dropped unread if its signatures agree in a share this far below the threshold (five deviations).
MARGIN = 0.2


def _universal(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


MULTIPLY, ADD = _universal(BANDS * ROWS)


def signature(s: np.ndarray, step: int = 2048) -> np.ndarray:
    out = np.full(len(MULTIPLY), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), step):
        x = np.multiply.outer(MULTIPLY, s[at : at + step])
        x += ADD[:, None]
        out = np.minimum(out, (x.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A long for each row and band."""
    x = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(scrambled(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sigs), BANDS))
    for r in range(ROWS):
        h = scrambled(h + x[:, :, r])
    return h.view(np.int64)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signed(k: int):
    """``f`` has a byte of each minimum, so that agreement can only grow by it; ``keys`` are the bands."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, k) for t in texts(batch.column(2))]
        sigs = [signature(s) if len(s) else None for s in sets]
        return {
            "doc_id": batch.column(0),
            "rid": batch.column(1),
            "n_shingles": [len(s) for s in sets],
            "digest": [digest(s) if len(s) else None for s in sets],
            "f": [None if x is None else x.astype(np.uint8).tobytes() for x in sigs],
            "keys": [None if x is None else band_keys(x[None]).tobytes() for x in sigs],
        }

    return run


def _banded(batch: pa.RecordBatch) -> dict:
    keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, BANDS)
    return {"cid": batch.column(0), "keys": list(keys)}


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b)
    shared = both - len(np.unique(np.concatenate([a, b])))
    return 100 * shared >= percent * (both - shared)


PLACE = "g long, i long, j long, side int, main boolean, comp long, cid long"
PLACED = ["g", "i", "j", "side", "main", "comp", "cid"]


class _Tile:
    """A block of a group's members (side 0), against which others (side 1) are held one by one."""

    def __init__(self, least: float) -> None:
        self.least, self.rows, self.f, self.sets, self.ready = least, [], [], [], False

    def add(self, row: tuple, f: bytes, s: bytes | None) -> None:
        self.rows.append(row)
        self.f.append(f)
        self.sets.append(None if s is None else np.frombuffer(s, "<u8"))

    def near(self, row: tuple, f: bytes) -> np.ndarray:
        """Places of members of other components with a near signature, by falling agreement."""
        if not self.ready:
            self.matrix = np.frombuffer(b"".join(self.f), np.uint8).reshape(len(self.f), -1)
            main, comp, cid = zip(*(r[4:7] for r in self.rows))
            self.outside, self.comp, self.cid = ~np.array(main), np.array(comp), np.array(cid)
            self.hit, self.ready = np.zeros(len(self.rows), bool), True
        # Two members outside the main component meet in both orders: once is enough.
        apart = np.flatnonzero((self.comp != row[5]) & ~(self.outside & (self.cid >= row[6])))
        agree = np.count_nonzero(self.matrix[apart] == np.frombuffer(f, np.uint8), axis=1)
        near = agree >= self.least
        return apart[near][np.argsort(-agree[near], kind="stable")]


KINDS = [pa.int64()] * 3 + [pa.int32(), pa.bool_()] + [pa.int64()] * 2


def _met(percent: int):
    """Rows in order of tile and side, with signatures: those that have a near partner in the tile."""
    least = (percent / 100 - MARGIN) * BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, out = None, _Tile(least), []

        def flush() -> pa.RecordBatch:
            if tile.ready:
                out.extend(tile.rows[k] for k in np.flatnonzero(tile.hit).tolist())
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(KINDS), KINDS)], names=PLACED)
            out.clear()
            return rows

        for batch in (part for whole in batches for part in sliced(whole)):
            for *row, f in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    yield flush()
                    at, tile = row[:3], _Tile(least)
                if row[3] == 0:
                    tile.add(tuple(row), f, None)
                elif tile.rows:
                    near = tile.near(row, f)
                    if len(near):
                        tile.hit[near] = True
                        out.append(tuple(row))
        yield flush()

    return run


def _linked(percent: int):
    """Rows in order of tile and side, with signatures and sets: a link for each merger of components in the tile."""
    least = (percent / 100 - MARGIN) * BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, root = None, _Tile(least), {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x] = root[root[x]]
            return x

        for batch in (part for whole in batches for part in sliced(whole)):
            xs, ys = [], []
            for *row, f, s in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    at, tile, root = row[:3], _Tile(least), {}
                if row[3] == 0:
                    tile.add(tuple(row), f, s)
                elif tile.rows:
                    mine = np.frombuffer(s, "<u8")
                    for k in tile.near(row, f).tolist():
                        a, b = find(tile.rows[k][5]), find(row[5])
                        if a != b and linked(tile.sets[k], mine, percent):
                            root[max(a, b)] = min(a, b)
                            xs.append(row[6])
                            ys.append(tile.rows[k][6])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return run


class _Work:
    """The classes of a table of documents, and the steps that link them."""

    def __init__(self, docs: DataFrame, k: int, percent: int, tile_rows: int, tile_bytes: int, broadcast_ids: int) -> None:
        self.docs, self.k, self.percent, self.broadcast_ids = docs, k, percent, broadcast_ids
        self.tile_rows, self.tile_bytes = tile_rows, tile_bytes
        self.partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.base = written(arrow_map(docs, _signed(k), "doc_id long, rid long, n_shingles long, digest binary, f binary, keys binary"))
        worded = self.base.where("digest is not null")
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("rep")
        found = worded.groupBy("digest").agg(rep, F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), F.first("f").alias("f"), F.first("keys").alias("keys"))
        # Numbers of classes hold from here on: they are in the table.
        self.classes = written(found.select(F.monotonically_increasing_id().alias("cid"), "digest", F.col("rep.doc_id").alias("ident"), F.col("rep.rid").alias("rid"), "n", "n_shingles", "f", "keys"))
        self.n_rows, self.n_classes = self.base.count(), self.classes.count()
        self.rows = written(join_totals(worded.select("doc_id", "rid", "n_shingles", "digest"), self.classes.select("digest", "cid", "n"), "digest", self.n_rows).select("doc_id", "rid", "n_shingles", "cid"))

    def sets(self, cids: DataFrame) -> DataFrame:
        """(cid, f, s): signatures and shingle sets of classes, made again from the text of one of their rows."""
        ids = written(self.classes.select("cid", "rid", "digest").join(cids.distinct(), "cid", "left_semi"))
        k, n = self.k, ids.count()

        def make(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"cid": [], "f": [], "s": []}
            for cid, want, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                s = shingle_set(t, k)
                if digest(s) == want:  # else another text with the same 64-bit hash
                    out["cid"].append(cid)
                    out["f"].append(signature(s).astype(np.uint8).tobytes())
                    out["s"].append(s.tobytes())
            return out

        # 32 bytes for each of at most broadcast_ids ids; beyond, the texts are joined by a shuffle.
        near = self.docs.join(F.broadcast(ids) if n <= self.broadcast_ids else ids, "rid").select("cid", "digest", "text")
        made = written(arrow_map(near, make, "cid long, f binary, s binary"))
        return written(made.dropDuplicates(["cid"])) if made.count() > n else made

    def in_tiles(self, rows: DataFrame, parts: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
        placed = rows.join(parts, "cid").select(*PLACED, *columns)
        return written(placed.repartition(self.partitions, "g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "cid").mapInArrow(run, schema))

    def linked_in_tiles(self, rows: DataFrame) -> DataFrame:
        return self.in_tiles(rows, self.sets(rows.select("cid")), ["f", "s"], _linked(self.percent), "x long, y long")

    def blocks(self, n: Column, shingles: Column) -> Column:
        """By rows and by bytes of sets."""
        return F.greatest(F.ceil(n / self.tile_rows), F.ceil(shingles * 8 / self.tile_bytes), F.lit(1)).cast("long")

    def shared_ids(self) -> DataFrame:
        """Links between classes that have rows of the same id."""
        ids = self.rows.where("doc_id is not null").select("doc_id", "cid").distinct()
        several = ids.groupBy("doc_id").agg(F.min("cid").alias("x"), F.count("*").alias("n")).where("n > 1")
        return join_totals(ids, written(several), "doc_id", self.n_rows).select("x", F.col("cid").alias("y"))

    def buckets(self) -> DataFrame:
        """(key, cid, lead) of buckets with more than one member."""
        bands = arrow_map(self.classes.select("cid", "keys"), _banded, "cid long, keys array<long>").select("cid", F.explode("keys").alias("key"))
        found = bands.groupBy("key").agg(F.min("cid").alias("lead"), F.count("*").alias("n")).where("n > 1")
        return written(join_totals(bands, written(found), "key", BANDS * self.n_classes).select("key", "cid", "lead"))

    def leaders(self, buckets: DataFrame) -> DataFrame:
        """Links of members with the leader of most of their buckets, in tiles of a leader and some of its members."""
        met = buckets.where("cid <> lead").groupBy("cid", "lead").count()
        pairs = written(met.groupBy("cid").agg(F.max_by("lead", F.struct("count", F.negative("lead"))).alias("lead")))
        sized = pairs.join(self.classes.select("cid", "n_shingles"), "cid")
        sizes = written(sized.groupBy("lead").agg(F.count("*").alias("n"), self.blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")))
        place = lambda side, j, cid: [F.col("lead").alias("g"), F.lit(0).cast("long").alias("i"), j.alias("j"), F.lit(side).alias("side"), F.lit(True).alias("main"), cid.alias("comp"), cid.alias("cid")]
        members = join_totals(pairs, sizes, "lead", self.n_classes).select(place(1, F.pmod(F.xxhash64("cid"), "blocks"), F.col("cid")))
        heads = sizes.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j")).select(place(0, F.col("j"), F.col("lead")))
        return self.linked_in_tiles(written(members.unionByName(heads)))

    def rest(self, buckets: DataFrame, component: DataFrame) -> DataFrame | None:
        """Links between components that share a bucket; None if no bucket holds more than one."""
        b = buckets.join(component.select(F.col("node").alias("cid"), "component"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
        b = written(b)
        by_comp = b.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key")
        mains = by_comp.agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.max(F.struct("m", "comp")).alias("top")).where("k > 1")
        mains = written(mains.select("key", "n", F.col("top.comp").alias("g")))
        if mains.isEmpty():
            return None
        # A member of several buckets with one main component is in the group once.
        b = join_totals(b, mains, "key", BANDS * self.n_classes).select("g", "cid", "comp").distinct()
        b = written(b.join(self.classes.select("cid", "n_shingles"), "cid"))
        out = F.col("comp") != F.col("g")
        s = F.col("n_shingles")
        sizes = b.groupBy("g").agg(F.count("*").alias("n"), self.blocks(F.count("*"), F.sum(s)).alias("n_i"), self.blocks(F.count_if(out), F.sum(F.when(out, s).otherwise(0))).alias("n_j"))
        b = join_totals(b, written(sizes), "g", BANDS * self.n_classes).withColumn("main", ~out)
        all_ = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        h = F.xxhash64("cid")
        inner = F.transform(all_("n_j"), lambda j: F.struct(F.pmod(h, "n_i").alias("i"), j.alias("j"), F.lit(0).alias("side")))
        outer = F.transform(all_("n_i"), lambda i: F.struct(i.alias("i"), F.pmod(h, "n_j").alias("j"), F.lit(1).alias("side")))
        places = F.concat(inner, F.when(F.col("main"), F.slice(outer, 1, 0)).otherwise(outer))
        rows = b.select("g", "main", "comp", "cid", F.explode(places).alias("p")).select("g", "p.i", "p.j", "p.side", "main", "comp", "cid")
        near = self.in_tiles(rows, self.classes.select("cid", "f"), ["f"], _met(self.percent), PLACE)
        return self.linked_in_tiles(near)

    def components(self, join_ids: bool) -> DataFrame:
        """(cid, component) of all classes."""
        buckets = self.buckets()
        links = self.leaders(buckets)
        if join_ids:
            links = links.unionAll(self.shared_ids())
        component = connected_components(links)
        more = self.rest(buckets, component)
        if more is not None and not more.isEmpty():
            component = connected_components(component.toDF("x", "y").unionAll(more))
        found = self.classes.select("cid").join(component.withColumnRenamed("node", "cid"), "cid", "left")
        return written(found.select("cid", F.coalesce("component", "cid").alias("component")))


def _slim(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(F.col(ident).cast("long").alias("doc_id"), _rid(ident, text).alias("rid"), F.col(text).cast("string").alias("text"))


def _rid(ident: str, text: str) -> Column:
    """Rows with equal id and text share it."""
    return F.xxhash64(F.col(ident).cast("long"), F.col(text).cast("string"))


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    ident: str = "doc_id",
    text: str = "text",
    tile_rows: int = 256,
    tile_bytes: int = 32 << 20,
    broadcast_ids: int = 200_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; ``docs`` is read more than once.

    Rows are linked if the sets of their k-word shingles have 100 * intersection >= percent * union. Rows without
    words (null, empty or white space) link with nothing, and each is its own component. Rows with words that share
    an id are one document: they are in one component, whatever their texts. component_id is the smallest id
    reachable; null ids count for nothing there, so it is null where no row reached has an id, and a row without an
    id is never kept. Other columns are ignored; an empty table stays empty.
    """
    work = _Work(_slim(docs, ident, text), k, percent, tile_rows, tile_bytes, broadcast_ids)
    label = work.classes.select("cid", "ident", "n").join(work.components(True), "cid")
    label = written(label)
    least = written(label.groupBy("component").agg(F.min("ident").alias("component_id"), F.count("*").alias("size")))
    label = join_totals(label, least, "component", work.n_classes, size="size").select("cid", "n", "component_id")
    out = join_totals(work.rows, written(label), "cid", work.n_rows).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(work.base.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` (all columns) with one row of each group of near copies: that of least id, null ids last.

    Links are those of ``near_duplicates``, but rows are told apart by id and text: rows that share an id and have
    different texts are documents of their own, and fully equal ones are copies. Rows without words all stay.
    """
    work = _Work(_slim(docs, ident, text), k, percent, **{"tile_rows": 256, "tile_bytes": 32 << 20, "broadcast_ids": 200_000} | options)
    rep = F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "rid", "cid")).alias("rep")
    kept = work.classes.select("cid", "ident", "rid").join(work.components(False), "cid").groupBy("component").agg(rep)
    kept = written(kept.select(F.col("rep.ident").alias("doc_id"), F.col("rep.rid").alias("rid"), F.lit(True).alias("stays")))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["rid"] == b["rid"])
    rows, stay = work.rows.select("doc_id", "rid").alias("a"), kept.alias("b")
    counted = rows.join(stay, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.rid") == F.col("b.rid")), "left").groupBy("a.doc_id", "a.rid").agg(F.count("*").alias("n"), F.bool_or("stays").alias("stays"))
    counted = written(counted.select(F.col("doc_id").alias("_i"), F.col("rid").alias("_r"), "n", F.coalesce("stays", F.lit(False)).alias("stays")))
    mark = "_rid"
    while mark in map(str.lower, docs.columns):
        mark += "_"
    found = docs.withColumn(mark, _rid(ident, text))
    one = lambda them: found[ident].cast("long").eqNullSafe(them["_i"]) & (found[mark] == them["_r"])
    gone = counted.where("not stays").select("_i", "_r")
    again = counted.where("stays and n > 1").select("_i", "_r")
    out = found.join(gone, one(gone), "left_anti")
    if again.isEmpty():
        return out.drop(mark)
    return out.join(again, one(again), "left_anti").unionByName(found.join(again, one(again), "left_semi").dropDuplicates([ident, mark])).drop(mark)
