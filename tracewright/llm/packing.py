"""Packing documents into training sequences by lexical retrieval.

Each document's full windows are sequences of their own; what is left of it, under one window, is packed. Pieces are
dealt to shards in order of a lexical key, so that neighbours meet and a frequent key is split by its rows. A shard
holds a bounded number of tokens and a BM25 inverted index over its pieces' tokens, with document frequencies of the
whole corpus. A seed's best unused neighbours fill its window greedily; the last is cut to fit and its rest stays in
the pool, so only a task's last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_map, sliced, written
from tracewright.llm.tokens import TOKENIZER, Tokenizer, decoded

#: The id that ends a document, a fixed value of the contract; the vocabulary's size bounds the frequencies' table.
END, VOCABULARY = 1, 50_257
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PARTS = f"kind int, {PIECE}, place long, ids binary"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def lexical_place(ids: np.ndarray, rare: int = 2000) -> int:
    """The least hash of a text's rarer tokens (in this vocabulary higher ids): texts that share many often share it."""
    x = ids[ids >= rare].astype(np.uint64)
    if not len(x):
        return int(ids[0])
    return int(((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)).min())


def _parts(window: int, tokenizer: str):
    """Rows of kind 0, full windows, done; 1, what is to be packed; 2, the task's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place")), ("ids", pa.binary())])
        encoder, frequency, full = Tokenizer(tokenizer), np.zeros(VOCABULARY, np.int64), 0
        first = (1 << 62) + (TaskContext.get().partitionId() << 36)
        for batch in (part for whole in batches for part in sliced(whole)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), decoded(batch.column(1))):
                ids = np.append(encoder.ids(text), np.uint16(END))
                frequency[np.unique(ids)] += 1
                at = 0
                while len(ids) - at >= window:
                    rows.append((0, doc_id, at, window, crc(ids[at : at + window]), len(ids), first + full, 0, 0, None))
                    full, at = full + 1, at + window
                if at < len(ids):
                    rows.append((1, doc_id, at, len(ids) - at, 0, len(ids), None, None, lexical_place(ids), ids[at:].astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        if frequency.any():
            row = (2, *[None] * 8, frequency.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, schema.types)], schema=schema)

    return run


class Shard:
    """BM25 over a bounded number of pieces."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, k1: float = 1.2, b: float = 0.75, terms: int = 24) -> None:
        self.n = len(pieces)
        found = [np.unique(p, return_counts=True) for p in pieces]
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in found])
        term, tf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        size = np.array([len(p) for p in pieces], np.float32)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / size.mean()))
        ends = np.cumsum([len(t) for t, _ in found])
        # A query is a piece's heaviest terms.
        self.queries = [t[np.argpartition(-w, terms)[:terms]] if len(t) > terms else t for (t, _), w in zip(found, np.split(weight, ends[:-1]))]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        self.at = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def neighbours(self, seed: int, unused: np.ndarray, most: int) -> np.ndarray:
        """Unused pieces by falling score, at most ``most``; ties by place."""
        q = self.queries[seed]
        spans = [slice(self.at[t], self.at[t + 1]) for t in q]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[~unused] = 0
        score[seed] = 0
        best = np.flatnonzero(score > 0)
        if len(best) > most:
            best = best[np.argpartition(-score[best], most)[:most]]
        return best[np.lexsort((best, -score[best]))]


def packed_shard(pieces: list[np.ndarray], idf: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, first token, tokens); only the last may be short."""
    shard = Shard(pieces, idf)
    start, unused, seed, waiting = np.zeros(len(pieces), np.int64), np.ones(len(pieces), bool), 0, []
    sizes = np.array([len(p) for p in pieces])
    while True:
        while seed < len(pieces) and not unused[seed]:
            seed += 1
        if seed == len(pieces):
            return
        room, row, ahead, anchor = window, [], iter([seed]), seed
        while room:
            k = next(ahead, None)
            if k is None:  # none left, or the list has run out: ask again, and without any neighbour go on in order
                near = shard.neighbours(anchor, unused, 32)
                waiting = near.tolist() or np.flatnonzero(unused)[:8].tolist()
                if not waiting:
                    break
                ahead = iter(waiting)
                continue
            if not unused[k]:
                continue
            n = min(room, int(sizes[k] - start[k]))
            row.append((k, int(start[k]), n))
            start[k] += n
            room -= n
            unused[k] = start[k] < sizes[k]
        yield row


def _pack(idf: np.ndarray, window: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        first, made = TaskContext.get().partitionId() << 36, 0
        held: list[tuple] = []
        tokens = 0

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal held, tokens, made
            pieces, rows, rest = [h[3] for h in held], [], []
            for sequence in packed_shard(pieces, idf, window):
                if not final and sum(n for _, _, n in sequence) < window:
                    rest = [(held[k][0], held[k][1] + at, held[k][2], pieces[k][at : at + n]) for k, at, n in sequence]
                    break
                offset = 0
                for k, at, n in sequence:
                    rows.append((held[k][0], held[k][1] + at, n, crc(pieces[k][at : at + n]), held[k][2], first + made, offset))
                    offset += n
                made += 1
            held, tokens = rest, sum(len(h[3]) for h in rest)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=names)

        for batch in batches:
            for doc_id, start, total, ids in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((doc_id, start, total, np.frombuffer(ids, "<u2")))
                tokens += len(held[-1][3])
                if tokens >= shard_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def packed(docs: DataFrame, window: int = 2048, ident: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, shard_tokens: int = 2_000_000) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of ``docs``.

    A document is its ids and the closing id; a null or empty text is that id alone. Each id is in exactly one piece;
    a sequence has ``window`` ids, but for the last of a task. Repeated rows are documents of their own; other
    columns are ignored; an empty table gives no pieces. ``docs`` is read once; the parts to be packed are
    written to the shared folder and shuffled once.
    """
    slim = docs.select(F.col(ident).cast("long"), F.col(text).cast("string"))
    parts = written(slim.mapInArrow(_parts(window, tokenizer), PARTS))

    def terms(batch: pa.RecordBatch) -> dict:
        total = sum((np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()), np.zeros(VOCABULARY, np.int64))
        found = np.flatnonzero(total)
        return {"term": found, "n": total[found]}

    # One number for each token of the vocabulary, which bounds what the driver gets.
    found = arrow_map(parts.where("kind = 2").select("ids"), terms, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(VOCABULARY)
    for r in found:
        frequency[r.term] = r.n
    size = parts.where("kind = 1").agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).first()
    documents = max(size.n, frequency.max(), 1)
    idf = np.log(1 + (documents - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    shards = max(1, -(-(size.tokens or 0) // shard_tokens))
    loose = parts.where("kind = 1").select("place", "doc_id", "start", "doc_tokens", "ids")
    loose = loose.repartitionByRange(shards, "place", "doc_id", "start").sortWithinPartitions("place", "doc_id", "start", "ids")
    filled = loose.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack(idf, window, shard_tokens), PIECE)
    return parts.where("kind = 0").select(*filled.columns).unionByName(filled)
