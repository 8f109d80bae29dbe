"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes, targets and keys are DataFrame expressions. A source's documents are taken in ascending order of
-ln(u) / quality, with u from a seeded hash of the document: complete epochs first, then those documents whose sizes
add up to the rest of the target. Order and running sums are distributed: the range of a source's keys is cut into
cells, whose sums give the cell in which the budget ends; that cell's own range is cut again, until it holds a bounded
number of rows, and only these are ordered and summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, written

#: Sources by code point weigh these in turn; a target stops at this multiple of its source. Fixed values of the contract.
WEIGHTS, MOST = (5, 2, 1), 3


def uniform(*columns: str | Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from the md5 of the columns: the same on each run and in other engines."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source.

    Weights repeat over the sources by code point, null last. Shares of the total over ``most`` times the source
    stop there and the excess is shared again by weight: in order of bound to weight, a source is bound if what is
    left, shared by the weights left, exceeds its bound. Small: a row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = sizes.withColumn("rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    w = w.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left_size") / F.sum("weight").over(after))
    w = w.withColumn("is_bound", F.col("weight") * F.col("level") >= F.col("bound"))
    level = F.max(F.when(~F.col("is_bound"), F.col("level"))).over(everything)  # of the first that is not bound
    return w.select("source", "source_size", F.when(F.col("is_bound"), F.col("bound")).otherwise(F.col("weight") * level).alias("target"))


def _narrowed(rows: DataFrame, spans: DataFrame, cells: int) -> DataFrame:
    """``spans`` (source, rest, low, high, before, n) cut to the cell of [low, high] in which ``rest`` ends.

    ``before`` is the size of the source's rows below ``low``, ``n`` the number of rows in the span.
    """
    width = F.col("high") - F.col("low")
    cell = F.when(width > 0, F.least(F.floor((F.col("key") - F.col("low")) / width * cells), F.lit(cells - 1))).otherwise(0)
    sums = rows.groupBy("source", "rest", "before", cell.cast("int").alias("cell")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    by_cell = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("sum").over(by_cell), F.lit(0)))
    last = sums.where("before <= rest").groupBy("source").agg(F.max_by(F.struct("rest", "low", "high", "before", "n"), "cell").alias("s"))
    return last.select("source", "s.*")


def mix_plan(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    cells: int = 1024,
    ordered: int = 5_000,
) -> DataFrame:
    """One row a source: source_size, target, complete epochs, low, and the last place (key, ident, size) of the fraction.

    ``rows`` is a table of source, key, ident and size. The fraction is the longest start of the source in key order
    of which the last document still fits by half, so taken words miss the target by at most half of one document
    (or of equal ones).
    Rows with a key below ``low`` are in it whole. A span is cut until it holds at most ``ordered`` rows or a single
    key; rows share a key only by sharing id and tie, and those of equal size are summed before they are ordered and
    stay together: they miss the target by at most half of their sum.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    sums = written(sums)
    plan = targets(sums.select("source", "source_size"), weights, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    spans = sums.alias("a").join(plan.select("source", "rest").alias("b"), same).select("a.source", "rest", "low", "high", F.lit(0).cast("long").alias("before"), "n")
    in_span = lambda r, s: r.alias("a").join(s.alias("b"), same & F.col("a.key").between(F.col("low"), F.col("high")))
    while True:
        spans = written(spans)
        if not spans.where((F.col("n") > ordered) & (F.col("low") < F.col("high"))).limit(1).count():
            break
        held = in_span(rows, spans).select("a.source", "key", "ident", "size", "rest", "before", "low", "high")
        spans = written(_narrowed(held, spans, cells))
        rows = written(in_span(rows, spans).select("a.source", "key", "ident", "size"))
    border = in_span(rows, spans).select("a.source", "key", "ident", "size", "rest", "before")
    border = border.groupBy("source", "key", "ident", "size", "rest", "before").agg(F.sum("size").alias("sum"))
    order = Window.partitionBy("source").orderBy("key", "ident", "size").rowsBetween(Window.unboundedPreceding, -1)
    border = border.withColumn("at", F.col("before") + F.coalesce(F.sum("sum").over(order), F.lit(0)))
    cut = border.where(F.col("at") + F.col("sum") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "ident", "size")).alias("cut"))
    ends = spans.alias("a").join(cut.alias("b"), same, "left").select("a.source", "low", "cut")
    out = plan.alias("a").join(ends.alias("b"), same, "left")
    return out.select("a.source", "source_size", "target", "epochs", "low", "cut")


def mixed(
    docs: DataFrame,
    size: Column,
    source: str = "source",
    ident: str = "doc_id",
    quality: Column | None = None,
    tie: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    seed: str = "mix",
    cells: int = 1024,
    ordered: int = 5_000,
) -> DataFrame:
    """``docs`` (all columns) with size, source_size, target, epochs and taken, the words the mix takes of each row.

    Columns of those names, in any case, are replaced; others may have any names. A row of size 0 or null is never taken. A null or
    non-positive quality counts as the least positive weight. ``tie`` tells rows of one ident, or of none, apart (the
    text's digest, say): a row's key is a hash of both. Rows equal in ident, ``tie`` and size are taken or left
    together, as is nearer to the target. No row is taken more than ``most`` times, rounded up to whole
    documents. A null source is a source of its own. An empty table stays empty. The rows' sizes and keys are written
    once; whole texts are read twice and never shuffled while the sources' table is small enough for Spark to
    broadcast it.
    """
    new = ["size", "source_size", "target", "epochs", "taken"]
    kept = [c for c in docs.columns if c.lower() not in new]
    quoted = lambda c: docs["`" + c.replace("`", "``") + "`"]
    w = F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(1e-6)) if quality is not None else F.lit(1.0)
    tie = F.lit("") if tie is None else F.coalesce(tie.cast("string"), F.lit(""))
    # Columns go by number until the end, so that no name of theirs can clash.
    sized = docs.select(
        *[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], quoted(source).alias("source"), F.struct(quoted(ident).alias("id"), tie.alias("tie")).alias("ident"),
        (-F.log(uniform(quoted(ident), tie, seed=seed)) / w).alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
    )
    slim = sized.select("source", "key", "ident", "size")
    plan = written(mix_plan(written(slim), weights, most, cells, ordered))
    rows = sized.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    place = F.struct(F.col("key"), F.col("ident"), F.col("size"))
    more = (F.col("key") < F.col("low")) | F.coalesce(place <= F.col("cut"), F.lit(False))
    extra = F.when(F.coalesce(more, F.lit(False)), F.col("size")).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", "epochs", taken.alias("taken"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str) -> Column:
    """The share of letters and white space among a text's characters: a plain stand-in for a quality model."""
    other = F.length(F.regexp_replace(F.col(text), r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(1 - F.try_divide(other, F.length(F.col(text))), F.lit(0.0))
