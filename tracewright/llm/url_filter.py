"""URL filters by a trie over reversed host labels and path segments.

The rules are compiled to one trie: a path of host labels from the right (``net``, ``example``), then at each
host node a path of URL segments. A rule's path holds for every URL path that starts with it as a string, so its
last, unfinished segment is kept at its node as a prefix. The longest host wins, then the longest path, then block
over allow. The trie is broadcast inside the task's closure only while the rules are at most ``broadcast_bytes``;
larger rule tables are matched by equi-joins of each URL's host suffixes with the rules instead.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_map, numbered_columns

#: (host, path, verdict); fixed values of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass"), slash + path


class Trie:
    """``labels`` and ``segments`` lead on; ``ends`` has the (prefix of the next segment, rule, verdict) that end here."""

    __slots__ = ("ends", "labels", "segments")

    def __init__(self) -> None:
        self.labels: dict[str, Trie] = {}
        self.segments: dict[str, Trie] = {}
        self.ends: list[tuple[str, str, str]] = []

    @classmethod
    def of(cls, rules: Iterable[tuple[str, str, str]]) -> "Trie":
        root = cls()
        for host, path, verdict in rules:
            if host is None or path is None:
                continue
            node = root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, cls())
            *whole, last = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, cls())
            node.ends.append((last, host + path, verdict))
        return root

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest host, then the longest path; block wins a tie."""
        found, node, hosts = None, self, [self]
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            hosts.append(node)
        for node in reversed(hosts[1:]):
            rest = path.split("/")
            depth = 0
            while node is not None:
                open_ends = [e for e in node.ends if depth < len(rest) and rest[depth].startswith(e[0])]
                if open_ends:
                    _, rule, verdict = max(open_ends, key=lambda e: (len(e[0]), e[2] == "block"))
                    found = rule, verdict
                if depth >= len(rest) - 1:
                    break
                node, depth = node.segments.get(rest[depth]), depth + 1
            if found:
                return found
        return None


def url_filter(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] | DataFrame,
    url: str = "url",
    default: str = "allow",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """Each row of ``pages`` with host, path, rule and verdict (columns of those names, in any case, are replaced).

    ``rules``: (host, path, allow or block), as rows or a table. A null url, or one without ``://``, has an empty
    host and path, fits no rule and gets ``default``, as does each URL that no rule fits. Repeated rows are judged
    each; an empty table gives an empty table. Rule tables of over ``broadcast_bytes`` are joined, not broadcast.
    Other columns may have any names. A rule with a null host or path fits nothing.
    """
    new = ["host", "path", "rule", "verdict"]
    if isinstance(rules, DataFrame):
        rules = rules.select(*rules.columns[:3]).toDF("rule_host", "rule_path", "rule_verdict")
        size = rules.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 16)).first()[0] or 0
        if size > broadcast_bytes:
            return _joined(pages, rules, url, default)
        rules = [tuple(r) for r in rules.collect()]
    trie, at, kept = Trie.of(rules), pages.columns.index(url), [i for i, c in enumerate(pages.columns) if c.lower() not in new]

    def judge(batch: pa.RecordBatch) -> dict:
        urls = batch.column(at).to_pylist()
        parts = [split_url(u) for u in urls]
        hits = [trie.match(h, p) for h, p in parts]
        out = {f"_c{i}": batch.column(i) for i in kept}
        return out | {
            "host": [h for h, _ in parts],
            "path": [p for _, p in parts],
            "rule": [x and x[0] for x in hits],
            "verdict": [x[1] if x else default for x in hits],
        }

    schema = ", ".join([f"_c{i} {pages.dtypes[i][1]}" for i in kept] + [f"{c} string" for c in new])
    return arrow_map(numbered_columns(pages), judge, schema).toDF(*[pages.columns[i] for i in kept], *new)


def _joined(pages: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """For rules without a size bound: each distinct (host, path) meets the rules of its host's suffixes by an equi-join."""
    names, pages = pages.columns, numbered_columns(pages)
    url = f"_c{names.index(url)}"
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    front = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    kept = [i for i, c in enumerate(names) if c.lower() not in ("host", "path", "rule", "verdict")]
    host = F.translate(F.regexp_extract(front, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Columns go by number until the end, so that no name of theirs can clash.
    parts = pages.select(*[F.col(f"_c{i}").alias(f"c{i}") for i in kept], host.alias("host"), F.regexp_extract(front, r"(?s)^[^/]*(.*)$", 1).alias("path"))
    keys = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = keys.withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").where("startswith(path, rule_path)")
    rank = F.struct(F.length("rule_host"), F.length("rule_path"), F.col("rule_verdict") == "block", "rule_host", "rule_path", "rule_verdict")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.rule_verdict").alias("v"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"c{i}").alias(names[i]) for i in kept], "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))
