"""Columns with dots, names that differ by case from what an operator adds, and names it uses itself, in all operators."""

import pytest

from tracewright.llm.conversation_repair import damaged, repaired
from tracewright.llm.decontamination import decontaminated
from tracewright.llm.line_dedup import line_dedup
from tracewright.llm.minhash import near_duplicates, without_near_duplicates
from tracewright.llm.mixing import mixed, word_count
from tracewright.llm.packing import packed
from tracewright.llm.periodic_runs import periodic_runs
from tracewright.llm.substring_dedup import substring_dedup
from tracewright.llm.tiff import tiff_encoded, tiff_pages
from tracewright.llm.tokens import token_counts
from tracewright.llm.toxicity import fit_toxicity, toxicity
from tracewright.llm.url_filter import RULES, url_filter

EXTRA = "`a.b` int, `x``y` int, _rid string, Host string, N_Lines int, Toxicity int, Media string, Page int, Kept_Text string, Size int, Taken int, shard int, Runs int, Spans int, rank int, h int, n int"
OWN = [f.split()[0].strip("`").replace("``", "`") for f in EXTRA.split(", ")]


def frame(spark, columns, rows):
    return spark.createDataFrame([(*r, *[str(i) if "string" in f else i for i, f in enumerate(EXTRA.split(", "))]) for r in rows], f"{columns}, {EXTRA}")


def others(*new):
    return [c for c in OWN if c.lower() not in new]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, "doc_id long, text string, source string", [(i, f"some words of {i}\nmore", "s") for i in range(12)])


@pytest.mark.parametrize(
    ("work", "new"),
    [
        (lambda d: line_dedup(d, min_docs=10, min_key=1), ["n_lines", "n_dropped", "kept_sha256", "kept_text"]),
        (lambda d: tiff_encoded(d), ["media"]),
        (lambda d: toxicity(d, fit_toxicity(d, d.sparkSession.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"))), ["toxicity"]),
        (lambda d: mixed(d, word_count("text")), ["size", "source_size", "target", "epochs", "taken"]),
        (lambda d: without_near_duplicates(d), []),
    ],
)
def test_columns_stay(docs, work, new):
    out = work(docs)
    assert out.columns == ["doc_id", "text", "source", *others(*new), *new]
    rows = out.collect()
    assert len(rows) == 12 and all(tuple(r)[3] == 0 and tuple(r)[4] == 1 and tuple(r)[5] == "2" for r in rows)


@pytest.mark.parametrize("work", [token_counts, packed, substring_dedup, near_duplicates, periodic_runs, lambda d: decontaminated(d, d.withColumnRenamed("doc_id", "item_id"))])
def test_columns_do_not_clash(docs, work):
    assert work(docs).count() > 0


def test_pages_of_files(docs):
    out = tiff_pages(tiff_encoded(docs))
    assert "a.b" in out.columns and "Page" not in out.columns and out.where("error IS NULL").count() == 12


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_urls(spark, broadcast):
    pages = frame(spark, "page_id long, `the.url` string", [(1, "http://a.net/x"), (2, None), (3, "http://b.org/" + "y/" * 50_000)])
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_filter(pages, rules, url="the.url", broadcast_bytes=broadcast)
    assert out.columns == ["page_id", "the.url", *others("host"), "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, len(r.path), r.rule) for r in out.collect()} == {1: ("a.net", 2, "net/"), 2: ("", 0, None), 3: ("b.org", 100_001, None)}


def test_conversations(spark):
    rows = frame(spark, "conv_id long, turn long, role string, text string", [(1, 0, "user", "Hm."), (1, 1, "assistant", "Yes.")])
    assert repaired(damaged(rows)).count() == 1
