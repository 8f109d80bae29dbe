r"""Final answers in the normal forms of three graders, as column expressions.

``final_form`` serves scores of ``Answer: ...`` lines, ``boxed_form`` scores of ``\boxed{...}``, ``graded_form`` is the
latter with a lone ``\text{...}`` opened. Each is a fixed order of fixed replacements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.once import bound

# Fixed values of the final form: replaced in this order.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
# Fixed values of the final form: removed in this order, after the substitutions.
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals",
    "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Fixed values of the final form: what is opened and completed, in this order (a point is no line end).
OPENED = [
    (r"(?d)(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(?d)(\\text\{)(.*?)(\})", "$2"), (r"(?d)(\\textbf\{)(.*?)(\})", "$2"), (r"(?d)(\\overline\{)(.*?)(\})", "$2"), (r"(?d)(\\boxed\{)(.*)(\})", "$2"),
    (r"(?d)(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}"),
]
# Fixed values of the boxed form: replaced in this order, before and after units go.
PLAIN = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
POINTS = [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")]
UNITS = "\\text{ "


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for before, after in pairs:
        text = F.replace(text, F.lit(before), F.lit(after))
    return text


def python_stripped(text: Column) -> Column:
    """Without what Python takes for white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def final_form(text: Column) -> Column:
    """After the last ``=``: without articles, spaces and units, commands opened, commas out of whole numbers; null for null."""
    out = _replaced(F.regexp_extract(text, r"([^=]*)\z", 1), SUBSTITUTIONS + [(w, "") for w in REMOVED])
    for pattern, to in OPENED:
        out = F.regexp_replace(out, pattern, to)
    digits = lambda v: F.when(F.regexp_like(F.replace(v, F.lit(","), F.lit("")), F.lit(r"^\p{Nd}+\z")), F.replace(v, F.lit(","), F.lit(""))).otherwise(v)
    return python_stripped(bound(F.replace(out, F.lit("$"), F.lit("")), digits))


def _fractions(text: Column) -> Column:
    r"""``\frac12`` and ``\frac1{2}`` with braces. A \frac with one bare character leaves the text as it is, one with nothing is an error (null)."""
    cut = F.regexp_extract(text, r"(?s)\\frac((?:(?!\\frac)[^{])?)(?=\\frac|\z)", 1)
    ends = F.regexp_like(text, F.lit(r"(?s)\\frac(?:(?!\\frac)[^{])?(?=\\frac|\z)"))
    whole = F.regexp_replace(F.regexp_replace(text, r"(?s)\\frac([^{])\{", r"\\frac{$1}{"), r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    return F.when(~ends, whole).when(cut != "", text)


def _roots(text: Column) -> Column:
    r"""``\sqrt3`` with braces; one with nothing after it is an error (null)."""
    return F.when(~F.regexp_like(text, F.lit(r"\\sqrt(?:\\sqrt|\z)")), F.regexp_replace(text, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}"))


def plain_number(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\A[0-9]{1,15}(?:\.[0-9]{1,15})?\z"))


def _with(mark: str, rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rule that leaves texts without the mark as they are."""
    return lambda v: F.when(F.contains(v, F.lit(mark)), rule(v)).otherwise(v)


def boxed_form(text: Column) -> Column:
    r"""Without spacing, units on the right, percent and degrees; \frac and \sqrt with braces, a/b as \frac. Null where the rules fail."""
    # No rule but that of 0.5 changes a plain number.
    return bound(text, lambda v: F.when(plain_number(v) & (v != "0.5"), v).otherwise(_boxed_rules(v)))


def _boxed_rules(text: Column) -> Column:
    out = _replaced(text, PLAIN)
    # Units are what the one "\text{ " begins; two of them are an error.
    count = lambda v: F.size(F.split(v, r"\\text\{ ", -1))
    out = bound(out, _with(UNITS, lambda v: F.when(count(v) <= 2, F.substring_index(v, UNITS, 1))))
    out = bound(_replaced(out, POINTS), lambda v: F.when(F.startswith(v, F.lit(".")), F.concat(F.lit("0"), v)).otherwise(v))
    name = lambda v: F.when(F.regexp_like(v, F.lit(r"(?s)^[^=]{0,2}=[^=]*\z")), F.substring_index(v, "=", -1)).otherwise(v)
    out = bound(bound(out, _with("=", name)), _with("\\sqrt", _roots))
    out = bound(F.replace(out, F.lit(" "), F.lit("")), _with("\\frac", _fractions))
    out = bound(out, lambda v: F.when(v == "0.5", r"\frac{1}{2}").otherwise(v))
    return bound(out, _with("/", lambda v: F.regexp_replace(v, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")))


def graded_form(text: Column) -> Column:
    r"""The boxed form of a stripped answer, a ``\text{...}`` around all of it opened; the answer itself where the rules fail."""
    # White space is below ! or above ~.
    strip = lambda v: F.when(v.between("!", "~") & F.right(v, F.lit(1)).between("!", "~"), v).otherwise(python_stripped(v))
    opened = bound(bound(text, strip), _with("\\text{", lambda v: F.when(F.regexp_like(v, F.lit(r"(?d)^\\text\{(.+?)\}$")), python_stripped(F.regexp_extract(v, r"(?d)^\\text\{(.+?)\}$", 1))).otherwise(v)))
    return bound(opened, lambda v: F.coalesce(boxed_form(v), v))


def same_boxed(a: Column, b: Column) -> Column:
    """Equal in boxed form; as they are, where the rules fail for one; two nulls are equal."""
    x, y = boxed_form(a), boxed_form(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(a == b, True).otherwise(F.coalesce(x == y, F.lit(False)))
