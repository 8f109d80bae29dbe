"""All tool calls of a text as rows, by grammars that users can add to.

A grammar is a function from a text to (name, arguments, error) of each call, in order. ``tool_calls`` runs it as a table
function on a lateral join, so a row gives as many rows as its text has calls; the grammar travels with the plan, so one
that a notebook defines works on executors too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Call = tuple[str | None, str | None, str | None]
Grammar = Callable[[str], Iterator[Call]]
COLUMNS = ("place", "name", "arguments", "error")
CALL = "place int, name string, arguments string, error string"
GRAMMARS: dict[str, Grammar] = {}

# The marks of the two grammars.
MARKED = r"(?s)<tool_call>(.*?)</tool_call>"
THOUGHTS = (r"(?s)<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>")
CHANNEL = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


def grammar(name: str) -> Callable[[Grammar], Grammar]:
    """Registers a grammar; a name that is taken is replaced."""

    def add(function: Grammar) -> Grammar:
        GRAMMARS[name] = function
        return function

    return add


@grammar("marked")
def marked(text: str) -> Iterator[Call]:
    """JSON objects of name and arguments between marks; what can't be read is an error."""
    for body in re.findall(MARKED, text):
        try:
            call = json.loads(body)
            if not isinstance(call, dict) or not isinstance(call.get("name"), str) or "arguments" not in call:
                raise ValueError("no object of name and arguments")
            yield call["name"], json.dumps(call["arguments"], ensure_ascii=False), None
        except (ValueError, RecursionError) as e:
            yield None, None, f"{type(e).__name__}: {e}"


@grammar("channels")
def channels(text: str) -> Iterator[Call]:
    """Calls on channels of their own; thoughts, which may hold calls too, don't count. Arguments stay as they are written."""
    for thought in THOUGHTS:
        text = re.sub(thought, "", text)
    for name, arguments in re.findall(CHANNEL, text):
        yield name, arguments, None


def found(name: str) -> Grammar:
    if name not in GRAMMARS:
        raise ValueError(f"no grammar {name}, but {', '.join(sorted(GRAMMARS))}")
    return GRAMMARS[name]


def _handler(parse: Grammar | None, keep: bool = False):
    """``keep``: a text without calls gives a row of nulls (a left lateral join would drop it)."""
    grammars = dict(GRAMMARS)

    class ToolCalls:
        def eval(self, text: str, name: str = ""):
            none = keep
            for place, call in enumerate((parse or grammars[name])(text) if text else ()):
                none = False
                yield (place, *call)
            if none:
                yield None, None, None, None

    return ToolCalls


def tool_calls(df: DataFrame, text: str = "text", grammar: str = "marked", how: str = "inner") -> DataFrame:
    """``df`` with a row for each call of ``text``: place (from 0), name, arguments (JSON), error; columns of those names are replaced.

    Null and empty texts have no calls; with ``how="left"`` rows without calls stay, with nulls. A broken call keeps
    its place and has an error instead of name and arguments. Other columns may have any names.
    """
    parse = F.udtf(_handler(found(grammar), how == "left"), returnType=CALL)
    # Columns go by number through the join, so that no name can clash.
    kept = [(i, c) for i, c in enumerate(df.columns) if c.lower() not in COLUMNS]
    slim = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    met = slim.lateralJoin(parse(F.col(f"_{df.columns.index(text)}").cast("string").outer()))
    return met.select(*[F.col(f"_{i}").alias(c) for i, c in kept], *COLUMNS)


def register_tool_calls(spark: SparkSession, name: str = "tool_calls") -> None:
    """For SQL: ``SELECT ... FROM t, LATERAL tool_calls(text, 'marked')``, with the grammars there are now."""
    spark.udtf.register(name, F.udtf(_handler(None), returnType=CALL))


def content(text: Column, grammar: str = "marked", pad: str | None = None) -> Column:
    """The text without its calls (broken ones go too), of channels without thoughts and padding as well."""
    if grammar == "marked":
        return F.regexp_replace(text, MARKED, "")
    out = F.replace(text, F.lit(pad), F.lit("")) if pad else text
    for pattern in (*THOUGHTS, CHANNEL):
        out = F.regexp_replace(out, pattern, "")
    return out
