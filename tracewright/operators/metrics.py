"""Evaluation roll-ups, batch metrics and vote statistics, as aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.once import bound
from tracewright.operators.order import MOST_CELLS, in_cells, quantiles, ranked


def share(hit: Column) -> Column:
    return F.avg(hit.cast("int"))


def accuracy_by(df: DataFrame, hit: str, group: str, kind: str) -> DataFrame:
    """n, correct and accuracy for each group and kind, for each group, and in all ('all'), in one pass."""
    sets = df.groupingSets([[group, kind], [group], []], group, kind)
    out = sets.agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("correct"), F.round(share(F.col(hit)), 6).alias("accuracy"))
    return out.select(F.coalesce(group, F.lit("all")).alias(group), F.coalesce(kind, F.lit("all")).alias(kind), "n", "correct", "accuracy")


def action_metrics(df: DataFrame, same: str, grounded: str, hit: str) -> DataFrame:
    """Totals, errors (null verdicts) and accuracies; 0 where a denominator is empty. ``overall`` needs type and place."""
    s, g, h = F.col(same), F.col(grounded), F.col(hit)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0)), 6)
    valid = s.isNotNull()
    return df.agg(
        F.count("*").alias("total"), F.count_if(~valid).alias("errors"), F.count_if(valid).alias("valid"),
        rate(s, valid).alias("type_accuracy"), rate(valid & g & h, valid & g).alias("grounding_accuracy"), rate(s & (~g | h), valid).alias("overall"),
    )


def weighted_sum(weights: dict[str, float]) -> Column:
    """Columns times their weights; a null measure counts for nothing."""
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))


def mean_and_deviation(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    aggs = [f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    out = df.groupBy(*by).agg(*aggs)
    return out.select(*by, *[F.round(f"_{c}_{n}", 6).alias(f"{c}_{n}") for c in columns for n in ("mean", "std")])


def best_and_worst_of(df: DataFrame, by: str, value: str, draws: list[int]) -> DataFrame:
    """Expected maximum and minimum of n draws with replacement from a group's values, for each n.

    Values i to j in order, of c, are the maximum with probability (j/c)^n - ((i-1)/c)^n. Equal values are one row with a
    count; places are counted in ranges between quantiles of the values, so a group's values are never gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    cells = min(MOST_CELLS, -(-counts.count() // 100_000))
    bounds = quantiles(counts, "_v", cells) if cells > 1 else []
    counts = in_cells(counts, "_v", bounds, "_cell") if bounds else counts.withColumn("_cell", F.lit(0))
    earlier = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(by, "_cell").agg(F.sum("_k").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    lower = Window.partitionBy(by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_below", F.coalesce(F.sum("_k").over(lower), F.lit(0))).join(starts, [by, "_cell"])
    placed = placed.join(counts.groupBy(by).agg(F.sum("_k").alias("_c")), by).withColumn("n", F.explode(F.array(*[F.lit(k) for k in draws])))
    i, c, n = (F.col("_start") + F.col("_below")).cast("double"), F.col("_c"), F.col("n")
    j = i + F.col("_k")
    best = F.col("_v") * (F.pow(j / c, n) - F.pow(i / c, n))
    worst = F.col("_v") * (F.pow((c - i) / c, n) - F.pow((c - j) / c, n))
    return placed.groupBy(by, "n").agg(F.round(F.sum(best), 6).alias("best"), F.round(F.sum(worst), 6).alias("worst"))


#: A draw: its place among its replicate's draws, and the columns of its row.
Drawn = Callable[[Column], Column]


def highest(value: str) -> Drawn:
    return lambda d: F.array_max(F.transform(d, lambda x: x[value]))


def lowest(value: str) -> Drawn:
    return lambda d: F.array_min(F.transform(d, lambda x: x[value]))


def average(value: str) -> Drawn:
    return lambda d: F.aggregate(d, F.lit(0.0), lambda a, x: a + x[value]) / F.size(d)


def voted(answer: str, value: str) -> Drawn:
    """The value of the first draw of the most common answer; of equally common ones the first drawn counts."""
    votes = lambda d: F.transform(d, lambda x: F.struct(F.size(F.filter(d, lambda y: y[answer].eqNullSafe(x[answer]))).alias("n"), (-x["draw"]).alias("first"), x[value].alias("value")))
    return lambda d: F.array_max(votes(d))["value"]


def bootstrapped(df: DataFrame, by: str, order: str, columns: list[str], size: int, replicates: int, reduce: dict[str, Drawn], seed: object = 42) -> DataFrame:
    """(``by``, mean and deviation of each reduce function) over replicates of ``size`` draws with replacement from a group.

    A reduce function goes from the array of draws (structs of draw and ``columns``, in order) to a value. Draws are
    hashes of seed, group, replicate and draw, so reruns and other engines agree; they meet a group's rows by place, so
    a group of any size is never gathered, and of each only what is drawn moves on. ``order`` is a whole number that
    differs within a group.
    """
    rows = ranked(df.select(by, order, *columns), by, [order], {"_range": F.floor(F.col(order) / 65_536)}, to="_place")
    drawn = df.groupBy(by).agg(F.count("*").alias("_c"))
    drawn = drawn.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string"), "_b", "draw")), 1, 8), 16, 10).cast("long")
    met = drawn.select(by, "_b", "draw", (number % F.col("_c")).alias("_place")).join(rows, [by, "_place"])
    sets = met.groupBy(by, "_b").agg(F.array_sort(F.collect_list(F.struct("draw", *columns))).alias("_d"))
    values = sets.select(by, *[f(F.col("_d")).cast("double").alias(f"_{n}") for n, f in reduce.items()])
    return values.groupBy(by).agg(*[g(f"_{n}").alias(f"{n}_{kind}") for n in reduce for kind, g in (("mean", F.avg), ("std", F.stddev_pop))])


def _shared_grams(h: Column, r: Column, n: int) -> Column:
    """How many n-grams of the characters ``h`` are in ``r`` too, each as often as it is in both: one walk over all in order, of equal ones those of ``h`` first."""
    mine, theirs = "\x00", "\x01"

    def grams(chars: Column, side: str) -> Column:
        starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda c, i: F.concat(c, *[chars[i + k] for k in range(1, n)], F.lit(side)))

    def step(a: Column, g: Column) -> Column:
        same, own = F.startswith(g, a["gram"]), F.endswith(g, F.lit(mine))
        state = lambda gram, left, hit: F.struct(gram.alias("gram"), left.alias("left"), hit.alias("hit"))
        new = state(F.when(same, a["gram"]).otherwise(F.substring(g, 1, n)), F.when(same, a["left"] + 1).otherwise(1), a["hit"])
        return F.when(own, new).when(same & (a["left"] > 0), state(a["gram"], a["left"] - 1, a["hit"] + 1)).otherwise(a)

    start = F.struct(F.lit(None).cast("string").alias("gram"), F.lit(0).alias("left"), F.lit(0).alias("hit"))
    return F.aggregate(F.sort_array(F.concat(grams(h, mine), grams(r, theirs))), start, step, lambda a: a["hit"])


def bleu(df: DataFrame, key: str, hypothesis: str, reference: str, most: int = 4) -> DataFrame:
    """(``key``, bleu): clipped n-gram precision of characters, of 1 to ``most``, with the brevity penalty.

    A row's n-grams are sorted and counted within the row, in time that grows with n log n of its texts; none is
    shuffled. A length of n-grams without a match, and an empty hypothesis, give 0; null texts are empty.
    """
    slim = df.select(F.col(key), F.coalesce(hypothesis, F.lit("")).alias("h"), F.coalesce(reference, F.lit("")).alias("r"))
    chars = lambda c: F.filter(F.split(c, ""), lambda v: v != "")

    def score(h: Column, r: Column) -> Column:
        rates = F.array(*[_shared_grams(h, r, n) / F.greatest(F.size(h) - (n - 1), F.lit(1)) for n in range(1, most + 1)])
        short = F.when(F.size(h) > F.size(r), 1.0).otherwise(F.exp(1 - F.try_divide(F.size(r), F.size(h))))
        mean = lambda x: F.exp(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.log(v)) / most)
        return bound(rates, lambda x: F.when(F.forall(x, lambda v: v > 0), short * mean(x)).otherwise(0.0))

    return slim.select(key, bound(chars(F.col("h")), lambda h: bound(chars(F.col("r")), lambda r: score(h, r))).alias("bleu"))


def majority(df: DataFrame, by: str, answer: str, value: str, order: str) -> DataFrame:
    """The most common answer of each group (the first seen of equals) and the value of its first row."""
    c = df.groupBy(by, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("v"))
    top = c.groupBy(by).agg(F.max_by(F.struct(answer, "v"), F.struct("n", F.negative("first"))).alias("t"))
    return top.select(by, F.col(f"t.{answer}").alias(answer), F.round("t.v", 6).alias("value"))


def batch_metrics(df: DataFrame, score: str, length: str, value: Column, most: int, aborted: Column) -> DataFrame:
    s, n = F.col(score), F.col(length)
    return df.agg(
        F.round(F.avg(s), 6).alias("score_mean"), F.round(F.max(s), 6).alias("score_max"), F.round(F.min(s), 6).alias("score_min"),
        F.round(F.avg(F.when(~aborted, s)), 6).alias("reward_mean"), F.round(F.avg(n), 6).alias("length_mean"), F.max(n).alias("length_max"),
        F.round(share(n >= most), 6).alias("clip_ratio"), F.round(share(aborted), 6).alias("aborted_ratio"),
        F.round(1 - F.try_divide(F.var_samp(s - value), F.var_samp(s)), 6).alias("explained"),
    )


def reduce_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """By what a metric is called: max before min before mean."""
    v = F.when(F.contains(F.col(name), F.lit("max")), F.max(value)).when(F.contains(F.col(name), F.lit("min")), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(F.round(v, 6).alias("value"))


def reduce_by_rule(df: DataFrame, name: str, value: str, weight: str, step: str, rules: dict[str, str]) -> DataFrame:
    """By an explicit rule for each name: last, weighted_avg, sum, avg, max or min; an unknown name is averaged."""
    how = {
        "last": F.max_by(value, step), "weighted_avg": F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)),
        "sum": F.sum(value), "avg": F.avg(value), "max": F.max(value), "min": F.min(value),
    }
    out = None
    for metric, rule in rules.items():
        mine = F.col(name) == metric
        out = F.when(mine, how[rule]) if out is None else out.when(mine, how[rule])
    return df.groupBy(name).agg(F.round(out.otherwise(how["avg"]), 5).alias("value"))
