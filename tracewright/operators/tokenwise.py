"""Token-level arithmetic on arrays in a row: masked sums, scans, divergences, clipped losses. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.once import bound

C = Column | str


def add(values: C) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def masked(values: C, mask: C) -> Column:
    """Values where the mask is set, 0 elsewhere; what the mask hides, NaN included, has no effect."""
    return F.zip_with(values, mask, lambda v, m: F.when(m > 0, v * m).otherwise(0.0))


def masked_sum(values: C, mask: C) -> Column:
    return add(masked(values, mask))


def masked_mean(values: C, mask: C, epsilon: float = 1e-8) -> Column:
    return masked_sum(values, mask) / (add(mask) + epsilon)


def masked_var(values: C, mask: C) -> Column:
    """Unbiased variance of the unmasked values; null for fewer than two."""
    n = add(mask)
    mean = masked_sum(values, mask) / n
    return F.when(n > 1, masked_sum(F.transform(values, lambda v: (v - mean) * (v - mean)), mask) / (n - 1))


def reverse_cumsum(values: C) -> Column:
    return discounted(values, F.transform(values, lambda _: F.lit(1.0)), 1.0)


def discounted(rewards: C, mask: C, gamma: float) -> Column:
    """From the end: r + gamma * what follows; a masked position resets what is carried."""
    steps = F.reverse(F.arrays_zip(F.col(rewards).alias("r") if isinstance(rewards, str) else rewards.alias("r"), F.col(mask).alias("m") if isinstance(mask, str) else mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        g = x["r"] + acc["g"] * gamma
        return F.struct((g * x["m"]).alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.reverse(F.aggregate(steps, start, step)["out"])


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages from the end; masked positions carry the state on unchanged."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = x["r"] + acc["next"] * gamma - x["v"] + acc["a"] * gamma * lam
        a = now * x["m"] + (1 - x["m"]) * acc["a"]
        return F.struct((x["v"] * x["m"] + (1 - x["m"]) * acc["next"]).alias("next"), a.alias("a"), F.concat(acc["out"], F.array(a)).alias("out"))

    return F.reverse(F.aggregate(steps, start, step)["out"])


def clamped(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def kl(a: Column, b: Column, kind: str) -> Column:
    """Estimates of divergence from two log-probabilities: k1, abs, k2 (mse), k3 (low variance, clamped)."""
    if kind == "k1":
        return a - b
    if kind == "abs":
        return F.abs(a - b)
    if kind == "k2":
        return (a - b) * (a - b) / 2
    if kind == "k3":
        d = clamped(b - a, -20.0, 20.0)
        return clamped(F.exp(d) - d - 1, -10.0, 10.0)
    raise ValueError(kind)


def ratio(a: Column, b: Column) -> Column:
    return F.exp(clamped(a - b, -20.0, 20.0))


def dual_clip(r: Column, advantage: Column, low: float, high: float, c: float) -> Column:
    """A token's loss: the worse of the plain and the clipped ratio; for negative advantages at most c times it."""
    worse = F.greatest(-advantage * r, -advantage * clamped(r, 1 - low, 1 + high))
    return F.when(advantage < 0, F.least(-advantage * c, worse)).otherwise(worse)


def after_first(values: C, bad) -> Column:
    """1 before the first value for which ``bad`` holds, 0 from there on."""
    flags = F.transform(values, lambda v: F.when(bad(v), 1).otherwise(0))
    at = F.array_position(flags, 1)
    return F.transform(values, lambda v, i: F.when((at == 0) | (i + 1 < at), 1.0).otherwise(0.0))


def last_after_marker(values: C, marker: Column) -> Column:
    """1 after the first marker, all ones without it."""
    at = F.array_position(values, marker)
    return F.transform(values, lambda v, i: F.when(i + 1 > at, 1.0).otherwise(0.0))


def log_softmax(values: C) -> Column:
    """Log-probabilities of an array of logits."""
    total = lambda high: high + F.log(add(F.transform(values, lambda v: F.exp(v - high))))
    return bound(bound(F.array_max(values), total), lambda t: F.transform(values, lambda v: v - t))


def most_likely(log_probs: C, k: int) -> Column:
    """Places from 0 of the k greatest, the first of equals first."""
    order = F.array_sort(F.transform(log_probs, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def with_tail(log_probs: C, places: C) -> Column:
    """Log-probabilities at the places, then that of all others together."""
    at = bound(log_probs, lambda p: F.transform(places, lambda i: F.get(p, i)))
    tail = lambda p: F.log(-F.expm1(F.least(F.log(add(F.transform(p, F.exp))), F.lit(-1e-7))))
    return bound(at, lambda p: F.concat(p, F.array(tail(p))))


def divergence(target: C, source: C, alpha: float) -> Column:
    """Of arrays of log-probabilities: KL(target, source) at 0, KL(source, target) at 1, the generalised Jensen-Shannon between."""
    kl = lambda x, y: add(F.zip_with(x, y, lambda u, v: F.exp(u) * (u - v)))
    if alpha in (0.0, 1.0):
        return kl(source, target) if alpha else kl(target, source)
    mixed = lambda u, v: F.log(F.exp(u) * alpha + F.exp(v) * (1 - alpha))
    each = lambda u, v: F.exp(u) * (u - mixed(u, v)) * alpha + F.exp(v) * (v - mixed(u, v)) * (1 - alpha)
    return add(F.zip_with(target, source, each))
