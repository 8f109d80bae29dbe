"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table, written
from tracewright.llm.line_dedup import line_dedup
from tracewright.llm.minhash import without_near_duplicates
from tracewright.llm.mixing import mixed, text_quality, word_count
from tracewright.llm.packing import packed
from tracewright.llm.toxicity import fit_toxicity, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 and more go.

    Null and empty texts score low and stay, as do rows without an id; equal texts go or stay together, repeated rows
    each. Without a toxic label the lists of words alone decide. An empty table stays empty.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).where("toxicity < 0.5").select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten and more documents share go; a document that has no other lines stays, empty.

    Repeated rows count as documents of their own. A null text is one empty line: it stays null, or becomes empty
    where ten documents have an empty line. n_chars is that of the new text, 0 for null.
    """
    out = line_dedup(docs.select(COLUMNS), min_docs=10, min_key=1)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least id (five words, similarity 0.8).

    Rows are told apart by id and text: different texts of one id are documents of their own, equal rows are copies.
    Null ids come last. Rows without words (null, empty or white space) all stay; an empty table stays empty.
    """
    return without_near_duplicates(docs.select(COLUMNS), k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it; those it doesn't take go.

    Rows without words (null and empty texts) have no size and go. A null source is one of its own. Repeated rows are
    documents of their own; those of one id are told apart by their texts, and equal ones at the end of a budget are
    taken or left together. An empty table stays empty.
    """
    out = mixed(docs.select(COLUMNS), word_count("text"), quality=text_quality("text"), tie=F.md5("text")).where("taken > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    A null or empty text is the closing id alone; copies and repeated rows are documents of their own, with pieces of
    their own. An empty table gives no pieces.
    """
    return packed(docs, window=2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Near duplicates, the learned score and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
