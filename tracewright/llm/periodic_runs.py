"""Runs of repeated words by the runs theorem.

A run is a maximal stretch of words with a smallest period q. Every run holds a Lyndon word of length q, under the order
of the words or under its inverse, that is the longest Lyndon word at its start. With a closing mark after the last
word, the longest Lyndon word at place i ends before the next place whose suffix is smaller, which next-smaller values
of the inverse suffix array give; next-greater values give those of the inverse order. Each such root is extended to the
right by the longest common prefix of two suffixes (least LCP between their places in the suffix array, from a sparse
table) and to the left by the same on the reversed words.

Documents of a batch share one suffix array: their words are numbers of (document, word), so that suffixes of different
documents differ at once and a document's suffixes are neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, arrow_map, texts
from tracewright.llm.shingles import rolled, word_hashes

RUNS = "array<struct<start:long,length:long,period:long>>"


class Suffixes:
    """Suffix ranks of symbols in which no repeated stretch reaches the end of its document."""

    def __init__(self, symbols: np.ndarray) -> None:
        """Prefix doubling; stretches that are told apart are not sorted again."""
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        first = _firsts(symbols[order])
        rank = np.empty(n, np.int64)
        rank[order] = first
        levels, open_, h = [rank.astype(np.int32)], order[_shared(first)], 1
        while len(open_):
            old, after = rank[open_], rank[open_ + h]
            by = np.lexsort((after, old))
            open_, old, after = open_[by], old[by], after[by]
            group = _firsts(old)
            part = _firsts(old * n + after)
            rank[open_] = old + part - group
            levels.append(rank.astype(np.int32))
            open_ = open_[_shared(part)]
            h *= 2
        self.levels, self.rank = levels, levels[-1]
        self.places = np.empty(n, np.int64)
        self.places[self.rank] = np.arange(n)
        self.lcp = self._neighbours()

    def _neighbours(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it in the suffix array."""
        n = len(self.rank)
        out = np.zeros(n, np.int64)
        at = np.flatnonzero(self.levels[0][self.places[1:]] == self.levels[0][self.places[:-1]]) + 1
        a, b = self.places[at - 1], self.places[at]
        for k in range(len(self.levels) - 1, -1, -1):
            # Ranks of a level are equal only where so many symbols are.
            same = self.levels[k][a] == self.levels[k][b]
            step = same.astype(np.int64) << k
            a, b = a + step, b + step
            out[at] += step
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at i and j (different places): the least LCP between them.

        The sparse table is made one level at a time, and queries are answered at the level of their width.
        """
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(hi - lo + 1)[1] - 1
        out, row, k = np.zeros(len(i), np.int64), self.lcp, 0
        for want in np.unique(level).tolist():
            while k < want:
                row = np.minimum(row[: -(1 << k)], row[1 << k :])
                k += 1
            q = level == want
            out[q] = np.minimum(row[lo[q]], row[hi[q] - (1 << k) + 1])
        return out


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Of ordered values, the place where each one's equals begin."""
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _shared(first: np.ndarray) -> np.ndarray:
    """Whether a value has equals, given where they begin."""
    alone = first == np.arange(len(first))
    return ~(alone & np.append(alone[1:], True))


def next_smaller(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next place of a smaller rank, and of a greater one; without one, the length."""
    n, out = len(rank), []
    for values, end in ((rank.tolist(), -1), ((-rank).tolist(), -n - 1)):
        values.append(end)
        after = [0] * n
        for i in range(n - 1, -1, -1):
            j, v = i + 1, values[i]
            while values[j] > v:
                j = after[j]
            after[i] = j
        out.append(np.array(after, np.int64))
    return out[0], out[1]


def _closed(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents, each with a closing mark that is its least, and where documents begin."""
    size = np.array([len(x) + 1 for x in ids], np.int64)
    begin = np.cumsum(size) - size
    symbols = np.concatenate([x for d in ids for x in (d + 1, np.zeros(1, np.int64))])
    return symbols + np.repeat(np.arange(len(ids)) * (symbols.max() + 1), size), begin


def _least_overlap(min_length: int, min_exponent: float) -> int:
    """The shortest common prefix of two neighbouring roots in any run that counts, where the first starts within the
    run's first period: of length L and period q they share L - 2q + 1 at least."""
    return min(max(min_length, int(np.ceil(min_exponent * q))) - 2 * q + 1 for q in range(1, min_length + 2))


def batch_runs(ids: list[np.ndarray], min_length: int = 2, min_exponent: float = 2) -> list[np.ndarray]:
    """For each document, given as numbers of its words, its runs (start, length, period), by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(ids)
    least = max(1, _least_overlap(min_length, min_exponent))
    which = _with_repeats(ids, least)
    if not len(which):
        return out
    symbols, begin = _closed([ids[d] for d in which])
    forward = Suffixes(symbols)
    i = np.arange(len(symbols))
    roots = []
    for j in next_smaller(forward.rank):
        ok = j < len(symbols)
        ok[ok] &= symbols[i[ok]] == symbols[j[ok]]
        a, b = i[ok], j[ok]
        right = forward.common(a, b)
        p = b - a
        # The first root of a run starts within its first period.
        enough = right >= np.maximum(np.maximum(min_length, np.ceil(min_exponent * p).astype(np.int64)) - 2 * p + 1, 1)
        roots.append(np.stack([a, b, right])[:, enough])
    a, b, right = np.concatenate(roots, axis=1)
    if not len(a):
        return out
    doc = np.searchsorted(begin, a, side="right") - 1
    # The same on reversed words, for documents with roots only.
    with_roots, mine = np.unique(doc, return_inverse=True)
    back, back_begin = _closed([ids[which[d]][::-1] for d in with_roots])
    n = np.array([len(ids[which[d]]) for d in with_roots], np.int64)
    x, y = a - begin[doc] - 1, b - begin[doc] - 1  # the words before
    left = np.zeros(len(a), np.int64)
    inner = x >= 0
    turned = back_begin[mine] + n[mine] - 1
    left[inner] = Suffixes(back).common((turned - x)[inner], (turned - y)[inner])
    found = np.stack([doc, a - begin[doc] - left, b - a + left + right, b - a], axis=1)
    found = found[found[:, 2] >= np.maximum(min_length, np.ceil(min_exponent * found[:, 3]))]
    found = np.unique(found[:, [0, 1, 3, 2]], axis=0)
    for part in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
        if len(part):
            out[which[part[0, 0]]] = part[:, [1, 3, 2]]
    return out


def _with_repeats(ids: list[np.ndarray], least: int) -> np.ndarray:
    """Documents in which some stretch of ``least`` words comes twice (an equal hash may add one, none is lost)."""
    if not ids or sum(map(len, ids)) == 0:
        return np.zeros(0, np.int64)
    symbols, begin = _closed(ids)
    if len(symbols) < least:
        return np.zeros(0, np.int64)
    h = rolled(symbols.astype(np.uint64), least)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.unique(np.searchsorted(begin, order[1:][same], side="right") - 1)


def word_numbers(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Equal words, by a 64-bit hash, get equal numbers."""
    ids = np.unique(word_hashes([w for d in documents for w in d]), return_inverse=True)[1].astype(np.int64)
    return np.split(ids, np.cumsum([len(d) for d in documents])[:-1]) if documents else []


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_length: int = 2, min_exponent: float = 2) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_text) for each row of ``docs``.

    Words are what ASCII white space separates. ``runs`` holds (start, length, period) of each run of at least
    ``min_length`` words and ``min_exponent`` (2 at least) periods, by start, then period; starts count words from 0.
    ``collapsed_text`` is the words, joined by one space, less those that a run holds after its first period. Null and
    empty texts have no words, no runs and an empty collapsed text. Rows are judged alone, so ids may be null or repeat;
    other columns are ignored; an empty table stays empty. A task holds about 4 MB of texts at a time, and a longer
    text whole.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")

    def solve(batch: pa.RecordBatch) -> dict:
        documents = [t.split() for t in texts(batch.column(1))]
        runs = batch_runs(word_numbers(documents), min_length, min_exponent)
        kept = []
        for words, found in zip(documents, runs):
            if len(found):
                words = [w for w, gone in zip(words, dropped(len(words), found).tolist()) if not gone]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        listed = [[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in runs]
        return {"doc_id": batch.column(0), "n_words": [len(d) for d in documents], "runs": listed, "collapsed_text": kept}

    slim = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(slim, solve, f"doc_id {slim.dtypes[0][1]}, n_words long, runs {RUNS}, collapsed_text string")


def with_periodic_tails(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text), where one in ten gets a periodic tail.

    With h the CRC of the id as text (null: empty) and g = floor(h / 10): if h is divisible by 10, each word i >= a
    becomes word a + (i - a) % p of n, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Texts without words
    stay as they are.
    """
    # Columns go one after the other, so that no name of the table can clash with them.
    out = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = out.withColumn("h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    planted = F.col("h") % 10 == 0
    out = out.withColumn("words", F.when(planted, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    out = out.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words").cast("long"))
    out = out.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    out = out.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return out.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
