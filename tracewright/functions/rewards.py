"""Rewards by functions that are given at run time, and the registries of rewards by name.

A file's source is read once, by Spark, and travels with the plan: executors need neither the file nor a package. The
function is called with a row's text, truth and bound arguments; coroutines of a batch run together, a bounded number at
a time.
"""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Rewards by the name of a data source; users add to it with ``reward``.
REWARDS: dict[str, Callable[..., Column]] = {}


def reward(*names: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    """Registers a function of columns (text, truth) under data sources' names; a name that is taken is replaced."""

    def add(function: Callable[..., Column]) -> Callable[..., Column]:
        REWARDS.update(dict.fromkeys(names, function))
        return function

    return add


def by_source(source: Column, text: Column, truth: Column, otherwise: float | None = None) -> Column:
    """Each row's reward by its source; a source without one gets ``otherwise``."""
    out = F.lit(otherwise).cast("double")
    for name, function in REWARDS.items():
        out = F.when(source == name, function(text, truth).cast("double")).otherwise(out)
    return out


@lru_cache(64)
def _function(source: str, path: str, name: str) -> Callable:
    space = {"__name__": "custom_reward", "__file__": path}
    exec(compile(source, path, "exec"), space)
    if not callable(space.get(name)):
        raise ValueError(f"{path} has no function {name}")
    return space[name]


def custom_reward(spark: SparkSession, path: str, name: str, together: int = 16, **bound) -> Callable[..., Column]:
    """A function of columns (text, truth) that scores by the function ``name`` of the file at ``path``, with bound arguments.

    ``path`` is any that Spark reads. The function gives a number, or a mapping with a number ``score``; an error in
    it fails the query. Up to ``together`` coroutines of a batch wait at a time. Nulls come as None; None gives null.
    """
    source = spark.read.text(path, wholetext=True).first()[0]
    function = _function(source, path, name)
    slow = inspect.iscoroutinefunction(function)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series, truths: pd.Series) -> pd.Series:
        call = _function(source, path, name)
        pairs = [tuple(None if pd.isna(x) else x for x in p) for p in zip(texts, truths)]
        number = lambda x: None if x is None else float(x["score"] if isinstance(x, dict) else x)
        if not slow:
            return pd.Series([number(call(t, g, **bound)) for t, g in pairs], dtype="float64")

        async def all_of() -> list:
            turn = asyncio.Semaphore(together)

            async def one(t, g):
                async with turn:
                    return await call(t, g, **bound)

            return await asyncio.gather(*[one(t, g) for t, g in pairs])

        return pd.Series([number(x) for x in asyncio.run(all_of())], dtype="float64")

    return score
