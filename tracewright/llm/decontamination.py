"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items make one automaton: each state stands for runs of words that occur at the same
places of items. A document's words are streamed through it; at each word the state and the length of the longest run
that ends there and occurs in some item are known. A run counts if it reaches an item's limit, ``window`` words or a
share of the item's words, whichever is less: the states at that limit carry the items that hold them.

Items are dealt to shards of a bounded number of words, each one automaton, built in tasks and kept as files in the
shared folder. A task holds a portion of documents and takes the shards in turn, so that memory is bounded by a shard
and a portion; one shard stays loaded.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import opened, shared_dir, sliced, texts, written

#: Bytes that words are made of once A-Z are lower-cased (digits, a-z, all beyond ASCII); others part them.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NORMAL = bytes(b if b in WORD_BYTES else 0x20 for b in bytes(range(256)).lower())
SPAN = "struct<start:long,length:long,longest:long>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty run.

    ``need`` of an item is the number of its consecutive words that make a hit. ``marks[s]`` lists (need, items) of the
    state s whose runs include the last ``need`` words of some place of these items, least need first; ``near[s]`` is
    the nearest state with marks among s and the states of its shorter suffixes, or 0.
    """

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.edges: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        self.marks: dict[int, list[tuple[int, list[int]]]] = {}
        self.near: list[int] = []
        self.width = 1

    @classmethod
    def of(cls, items: list[list[bytes]], needs: list[int]) -> "Automaton":
        out = cls()
        numbers = [[out.words.setdefault(w, len(out.words)) for w in item] for item in items]
        out.width = max(1, len(out.words))
        out._grow(numbers)
        out._mark(numbers, needs)
        return out

    def _grow(self, items: list[list[int]]) -> None:
        out: list[dict[int, int]] = [{}]
        length, link = self.length, self.link

        def state(of: dict[int, int], n: int, to: int) -> int:
            out.append(of)
            length.append(n)
            link.append(to)
            return len(out) - 1

        def split(p: int, c: int, q: int) -> int:
            """A state for the runs of q that go on from p or its suffixes."""
            if length[q] == length[p] + 1:
                return q
            twin = state(dict(out[q]), length[p] + 1, link[q])
            link[q] = twin
            while p >= 0 and out[p].get(c) == q:
                out[p][c] = twin
                p = link[p]
            return twin

        for item in items:
            last = 0
            for c in item:
                if c in out[last]:  # an item before has this run
                    last = split(last, c, out[last][c])
                    continue
                new, p = state({}, length[last] + 1, 0), last
                while p >= 0 and c not in out[p]:
                    out[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, c, out[p][c])
                last = new
        width = self.width
        self.edges = {s * width + c: t for s, on in enumerate(out) for c, t in on.items()}

    def _mark(self, items: list[list[int]], needs: list[int]) -> None:
        found: dict[int, dict[int, dict[int, None]]] = {}
        for k, (item, need) in enumerate(zip(items, needs)):
            s = 0
            for n, c in enumerate(item, 1):
                s = self.edges[s * self.width + c]
                if n < need:
                    continue
                # The run's last ``need`` words; dropping longer suffixes first is dropping words in front.
                while self.length[self.link[s]] >= need:
                    s = self.link[s]
                found.setdefault(s, {}).setdefault(need, {})[k] = None
        self.marks = {s: [(n, list(ks)) for n, ks in sorted(by.items())] for s, by in found.items()}
        self.near = [0] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.near[s] = s if s in self.marks else self.near[self.link[s]]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[int]]:
        """Hits (first word, word after the last, longest run that ends there), in order of their ends, and the items."""
        edges, length, link, near, marks, width = self.edges, self.length, self.link, self.near, self.marks, self.width
        hits, seen, items = [], set(), set()
        s = n = 0
        for i, c in enumerate(map(self.words.get, words)):
            if c is None:
                s = n = 0
                continue
            t = edges.get(s * width + c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = edges.get(s * width + c)
            if t is None:
                n = 0
                continue
            s, n = t, n + 1
            m = near[s]
            if not m:
                continue
            reach = 0
            while m:
                whole = m != s or n == length[s]
                for need, held in marks[m]:
                    if whole or need <= n:
                        reach = max(reach, need)
                        if (m, need) not in seen:
                            seen.add((m, need))
                            items.update(held)
                m = near[link[m]]
            if reach:
                hits.append((i + 1 - reach, i + 1, n))
        return hits, items

    def bytes(self, idents: list[str | None]) -> bytes:
        flat = [(s, n, k) for s, by in self.marks.items() for n, ks in by for k in ks]
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, pa.schema([("name", pa.string()), ("part", pa.large_binary())])) as out:
            parts = {
                "words": pa.array(list(self.words), pa.large_binary()), "idents": pa.array(idents, pa.large_string()), "edges": np.array([*self.edges], np.int64), "targets": np.array([*self.edges.values()], np.int32),
                "length": np.array(self.length, np.int32), "link": np.array(self.link, np.int32), "near": np.array(self.near, np.int32), "marks": np.array(flat, np.int32).reshape(-1, 3),
            }
            for name, part in parts.items():
                if isinstance(part, np.ndarray):
                    held = part.tobytes()
                else:
                    inner = io.BytesIO()
                    with pa.ipc.new_stream(inner, pa.schema([("x", part.type)])) as s:
                        s.write_batch(pa.record_batch([part], ["x"]))
                    held = inner.getvalue()
                out.write_batch(pa.record_batch([pa.array([name]), pa.array([held], pa.large_binary())], ["name", "part"]))
        return sink.getvalue()

    @classmethod
    def read(cls, name: str) -> tuple["Automaton", list[str | None]]:
        store, path = opened(name)
        with store.open_input_stream(path) as source:
            parts = {b.column(0)[0].as_py(): b.column(1)[0].as_py() for b in pa.ipc.open_stream(source.read())}
        listed = {k: pa.ipc.open_stream(parts[k]).read_all().column(0).to_pylist() for k in ("words", "idents")}
        numbers = lambda k, kind=np.int32: np.frombuffer(parts[k], kind).tolist()
        out = cls()
        out.words = {w: i for i, w in enumerate(listed["words"])}
        out.width = max(1, len(out.words))
        out.edges = dict(zip(numbers("edges", np.int64), numbers("targets")))
        out.length, out.link, out.near = numbers("length"), numbers("link"), numbers("near")
        for s, n, k in np.frombuffer(parts["marks"], np.int32).reshape(-1, 3).tolist():
            by = out.marks.setdefault(s, [])
            if not by or by[-1][0] != n:
                by.append((n, []))
            by[-1][1].append(k)
        return out, listed["idents"]


def need_of(n: int, window: int, share: float) -> int:
    """Consecutive words of an item of n words that make a hit."""
    return max(1, min(window, int(np.ceil(share * n))))


def spans_of(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Hits that meet or overlap as one: first word, number of words, longest run."""
    out: list[list[int]] = []
    for a, b, n in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] = max(out[-1][2], n)
        else:
            out.append([a, b, n])
    return [(a, b - a, n) for a, b, n in out]


def without_spans(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text less everything from a span's first word to its last."""
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, n, _ in spans:
        out.append(text[at : starts[a]])
        at = int(ends[a + n - 1])
    return b"".join([*out, text[at:]])


def item_shards(items: DataFrame, window: int, share: float, ident: str, text: str, shard_words: int) -> list[str]:
    """Files of the shards' automata."""
    spark = items.sparkSession
    slim = items.select(F.col(ident).cast("string").alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    slim = written(slim)
    # Words are parted by one byte at least.
    total = slim.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    folder = shared_dir(spark)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [words_of(t.encode()) for t in pdf.text]
        ids = [None if pd.isna(x) else x for x in pdf.item]
        built = Automaton.of(words, [need_of(len(w), window, share) for w in words])
        name = f"{folder}/{uuid.uuid4().hex}.automaton"
        store, path = opened(name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(built.bytes(ids))
        return pd.DataFrame({"file": [name]})

    made = slim.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards))).groupBy("shard").applyInPandas(build, "file string")
    return [r.file for r in written(made).collect()]


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    share: float = 1.0,
    ident: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    shard_words: int = 500_000,
    held_bytes: int = 32 << 20,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, coverage, kept_text) for each row of ``docs``.

    Words are digits, letters a-z (A-Z count as a-z) and what is beyond ASCII; all else parts them. A hit is a run of
    ``window`` words of a test item, or of ``share`` of its words if that is less (1.0: the whole of a shorter item).
    ``spans`` are the hit words as (start, length, longest run of an item that ends there), ``n_hit`` their number,
    ``coverage`` their share of the document, by which whole documents may be dropped; ``items`` the ids (as text,
    each once, in no order) of items with hits; ``kept_text`` the text less its spans.

    Null and empty texts have no words; kept_text stays null where the text is. Items without words hit nothing; items
    with a null id hit but aren't listed; rows that share an id are one item. Repeated documents are judged each, other
    columns are ignored, without documents the result is empty, without items nothing is hit. A task holds about
    ``held_bytes`` of documents and one shard of at most about ``shard_words`` words (a longer item whole); the work is
    the product of the documents and the shards of items.
    """
    files = item_shards(items, window, share, item, item_text, shard_words)
    slim = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {slim.dtypes[0][1]}, n_words long, n_hit long, items array<string>, spans array<{SPAN}>, coverage double, kept_text string"
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [Automaton.read(files[0])] if len(files) == 1 else None
        for portion in _portions(batches, held_bytes):
            raw = [texts(b.column(1)) for b in portion]
            words = [[words_of(t) for t in part] for part in raw]
            hits = [[[] for _ in part] for part in raw]
            found: list[list[set]] = [[set() for _ in part] for part in raw]
            for automaton, idents in loaded or map(Automaton.read, files):
                for p, part in enumerate(words):
                    for d, ws in enumerate(part):
                        at, ks = automaton.match(ws)
                        if at:
                            hits[p][d] += at
                            found[p][d].update(idents[k] for k in ks)
            for p, batch in enumerate(portion):
                spans = [spans_of(h) for h in hits[p]]
                n_hit, n_words = [sum(n for _, n, _ in s) for s in spans], [len(w) for w in words[p]]
                kept = [without_spans(t, s).decode("utf-8", "replace") if s else t.decode("utf-8", "replace") for t, s in zip(raw[p], spans)]
                columns = {
                    "doc_id": batch.column(0),
                    "n_words": n_words,
                    "n_hit": n_hit,
                    "items": [[x for x in f if x is not None] for f in found[p]],
                    "spans": [[{"start": a, "length": n, "longest": m} for a, n, m in s] for s in spans],
                    "coverage": [h / n if n else 0.0 for h, n in zip(n_hit, n_words)],
                    "kept_text": [k if there else None for k, there in zip(kept, batch.column(1).is_valid().to_pylist())],
                }
                yield pa.RecordBatch.from_pydict(columns, schema=kinds)

    return slim.mapInArrow(run, schema)


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
