r"""Whether two answers in LaTeX or plain notation have one value.

An expression is read to a quotient of two sums of monomials with rational coefficients: its atoms are variables, primes
under roots, function values and roots of sums, with rational exponents. Two expressions are equal if cross products
agree term by term; constants also if their values agree to four digits. Intervals, tuples, lists and matrices are
compared part by part.
"""

from __future__ import annotations

import cmath
import math
import re
from fractions import Fraction
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracewright.functions.answers import graded_form, plain_number, python_stripped
from tracewright.functions.once import bound
from tracewright.functions.text import closed as before_brace

#: Beyond, an expression is not compared as a formula.
MOST_TERMS, MOST_POWER, MOST_LENGTH = 400, 64, 1000
FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "abs": abs}
TOKEN = re.compile(r"\s*(\d+(?:\.\d*)?|\.\d+|\\?(?:frac|sqrt|pi|infty|inf|cdot|times|div|arcsin|arccos|arctan|sin|cos|tan|ln|log|exp)(?![a-z])|\\[A-Za-z]+|[A-Za-z]\d*|[-+*/^(){}\[\]|!])")
NAME = re.compile(r"[A-Za-z]+\d*")
#: Other notations of what the reader knows.
SAME = [("\\left", ""), ("\\right", ""), ("\\!", ""), ("\\,", ""), ("\\;", ""), ("\\ ", " "), ("dfrac", "frac"), ("tfrac", "frac"), ("**", "^"), ("−", "-"), ("·", "*"), ("×", "*"), ("÷", "/"), ("√", "sqrt"), ("π", "\\pi "), ("∞", "\\infty ")]

Sum = dict[tuple, Fraction]
ONE: Sum = {(): Fraction(1)}


class Unread(ValueError):
    """Not an expression, or one too large to compare."""


def _monomial(powers: dict, by: Fraction) -> tuple[tuple, Fraction]:
    """Whole powers of primes go to the coefficient, of i to its sign."""
    out = []
    for atom, n in powers.items():
        if isinstance(atom, int):
            whole = math.floor(n)
            by, n = by * Fraction(atom) ** whole, n - whole
        elif atom == "i" and n.denominator == 1:
            by, n = by * (-1 if n % 4 > 1 else 1), n % 2
        if n:
            out.append((atom, n))
    return _ordered(out), by


def _ordered(items) -> tuple:
    items = tuple(items)
    return items if len(items) < 2 else tuple(sorted(items, key=repr))


def _add(a: Sum, b: Sum, times: int = 1) -> Sum:
    out = dict(a)
    for m, c in b.items():
        c = c if times == 1 else times * c
        out[m] = out[m] + c if m in out else c
    return {m: c for m, c in out.items() if c}


def _times(a: Sum, b: Sum) -> Sum:
    if len(a) * len(b) > 50 * MOST_TERMS:
        raise Unread("too many terms")
    for one, other in ((a, b), (b, a)):
        if len(one) == 1 and () in one and len(other) <= MOST_TERMS:  # a number times terms that are in form
            c = one[()]
            return dict(other) if c == 1 else {m: c * d for m, d in other.items()}
    out: Sum = {}
    for (m, c), (n, d) in product(a.items(), b.items()):
        powers = dict(m)
        for atom, k in n:
            powers[atom] = powers.get(atom, Fraction(0)) + k
        key, by = _monomial(powers, c * d)
        # Whole powers of roots of sums are sums again.
        roots = [(x, k) for x, k in key if isinstance(x, tuple) and x[0] == "sum" and k >= 1]
        part: Sum = {tuple((x, k) if (x, k) not in roots else (x, k - math.floor(k)) for x, k in key if (x, k) not in roots or k != math.floor(k)): by}
        for x, k in roots:
            for _ in range(math.floor(k)):
                part = _times(part, dict(x[1]))
        out = _add(out, part)
    if len(out) > MOST_TERMS:
        raise Unread("too many terms")
    return out


def _factors(n: int) -> dict[int, int]:
    out, p = {}, 2
    while p * p <= n and p < 10_000:
        while n % p == 0:
            out[p], n = out.get(p, 0) + 1, n // p
        p += 1
    if n > 1:
        out[n] = out.get(n, 0) + 1
    return out


def _rational_power(r: Fraction, q: Fraction) -> Sum:
    if r == 0:
        if q <= 0:
            raise Unread("zero to a power")
        return {}
    powers: dict = {}
    if r < 0:
        if q.denominator == 2:
            powers["i"] = Fraction(q.numerator)
        elif q.denominator % 2 == 0:
            raise Unread("a root of a negative number")
    for part, way in ((abs(r.numerator), 1), (r.denominator, -1)):
        for p, k in _factors(part).items():
            powers[p] = powers.get(p, Fraction(0)) + k * way * q
    key, by = _monomial(powers, Fraction(-1 if r < 0 and q.denominator % 2 and q.numerator % 2 else 1))
    return {key: by}


class Value:
    """A quotient of sums."""

    __slots__ = ("bottom", "top")

    def __init__(self, top: Sum, bottom: Sum = ONE) -> None:
        if not bottom:
            raise Unread("division by zero")
        if bottom is ONE:
            if len(top) > MOST_TERMS:
                raise Unread("too many terms")
        elif len(bottom) == 1:  # one monomial divides each term
            (m, c), = bottom.items()
            top, bottom = _times(top, dict([_monomial({a: -k for a, k in m}, 1 / c)])), ONE
        self.top, self.bottom = top, bottom

    @classmethod
    def of(cls, n: Fraction | int) -> "Value":
        return cls({(): Fraction(n)} if n else {})

    @classmethod
    def atom(cls, name) -> "Value":
        return cls({((name, Fraction(1)),): Fraction(1)})

    def __add__(self, o: "Value") -> "Value":
        return Value(_add(_times(self.top, o.bottom), _times(o.top, self.bottom)), _times(self.bottom, o.bottom))

    def __neg__(self) -> "Value":
        return Value({m: -c for m, c in self.top.items()}, self.bottom)

    def __mul__(self, o: "Value") -> "Value":
        return Value(_times(self.top, o.top), _times(self.bottom, o.bottom))

    def inverse(self) -> "Value":
        return Value(self.bottom, self.top)

    def rational(self) -> Fraction | None:
        return self.top.get((), Fraction(0)) if (self.bottom is ONE or self.bottom == ONE) and (not self.top or len(self.top) == 1 and () in self.top) else None

    def key(self) -> tuple:
        return _ordered(self.top.items()), _ordered(self.bottom.items())

    def __pow__(self, o: "Value") -> "Value":
        q = o.rational()
        if q is None:
            return Value.atom(("power", self.key(), o.key()))
        r = self.rational()
        if r is not None and (q.denominator > 1 or r):
            if abs(q.numerator) * max(r.numerator.bit_length(), r.denominator.bit_length()) > 10_000:
                raise Unread("a power too large")
            return Value({(): r**q.numerator} if r**q.numerator else {}) if q.denominator == 1 else Value(_rational_power(r, q))
        if abs(q) > MOST_POWER:
            raise Unread("a power too large")
        base = self if q >= 0 else self.inverse()
        out, whole = Value.of(1), math.floor(abs(q))
        for _ in range(whole):
            out = out * base
        rest = abs(q) - whole
        return out * base._root(rest) if rest else out

    def _root(self, q: Fraction) -> "Value":
        """A power between 0 and 1: of a rational factor and a variable, or of a sum as an atom of its own."""
        if self.bottom != ONE:
            return Value(Value(self.top)._root(q).top, ONE) * Value(self.bottom)._root(q).inverse()
        size = Fraction(math.gcd(*(c.numerator for c in self.top.values())), math.lcm(*(c.denominator for c in self.top.values()))) if self.top else Fraction(1)
        rest = {m: c / size for m, c in self.top.items()}
        if rest == ONE:
            return Value(_rational_power(size, q))
        (first, by), *more = rest.items()
        alone = not more and by == 1 and len(first) == 1 and first[0][1] == 1
        return Value(_rational_power(size, q)) * Value({((first[0][0], q),): Fraction(1)} if alone else {((("sum", tuple(sorted(rest.items(), key=repr))), q),): Fraction(1)})

    def number(self, pi: float) -> complex | None:
        """The value of a constant; null with variables in it."""

        def of(terms) -> complex:
            total = 0j
            for m, c in terms:
                v = complex(c)
                for a, k in m:
                    v *= base(a) ** float(k)
                total += v
            return total

        def base(a) -> complex:
            if isinstance(a, int):
                return complex(a)
            if a in ("pi", "i", "e"):
                return {"pi": complex(pi), "i": 1j, "e": complex(math.e)}[a]
            if isinstance(a, tuple):
                if a[0] == "sum":
                    return of(a[1])
                if a[0] == "power":
                    return quotient(a[1]) ** quotient(a[2])
                return complex(FUNCTIONS[a[0]](quotient(a[1])))
            raise KeyError(a)

        quotient = lambda key: of(key[0]) / of(key[1])
        try:
            return quotient(self.key())
        except (KeyError, ValueError, OverflowError, ZeroDivisionError):
            return None


def same_value(a: Value, b: Value) -> bool:
    if a.bottom is ONE and b.bottom is ONE:
        return a.top == b.top
    return not _add(_times(a.top, b.bottom), _times(b.top, a.bottom), -1)


class Reader:
    """One expression; juxtaposed parts are multiplied, a whole number before a fraction of numbers is added."""

    def __init__(self, text: str) -> None:
        if len(text) > MOST_LENGTH:
            raise Unread("too long")
        for before, after in SAME:
            text = text.replace(before, after)
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise Unread(text[at:])
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        token = self.next()
        if not token or want is not None and token != want:
            raise Unread(f"{want} expected, {token} found")
        self.at += 1
        return token

    def whole(self) -> Value:
        out = self.sum()
        if self.next():
            raise Unread(self.next())
        return out

    def sum(self) -> Value:
        out = self.term()
        while self.next() in ("+", "-"):
            out = out + (self.term() if self.take() == "+" else -self.term())
        return out

    def term(self) -> Value:
        out = self.signed()
        while True:
            token = self.next()
            if token in ("*", "\\cdot", "\\times", "cdot", "times"):
                self.take()
                out = out * self.signed()
            elif token in ("/", "\\div", "div"):
                self.take()
                out = out * self.signed().inverse()
            elif token and token not in ("+", "-", ")", "}", "]", "|", "^", "!"):
                out = out * self.power()
            else:
                return out

    def signed(self) -> Value:
        if self.next() in ("+", "-"):
            return self.signed() if self.take() == "+" else -self.signed()
        return self.power()

    def power(self) -> Value:
        mixed = self.next().isdecimal() and self.tokens[self.at + 1 : self.at + 2] in (["\\frac"], ["frac"])
        out = self.part()
        if mixed:
            at, fraction = self.at, self.part()
            if fraction.rational() is not None and 0 < fraction.rational() < 1:
                return out + fraction
            self.at = at
        while self.next() == "!":
            self.take()
            n = out.rational()
            if n is None or n.denominator > 1 or not 0 <= n <= 100:
                raise Unread("a factorial")
            out = Value.of(math.factorial(int(n)))
        if self.next() == "^":
            self.take()
            sign = self.next() == "-" and bool(self.take())
            by = self.power() if self.next() != "{" else self.group()
            out = out ** (-by if sign else by)
        return out

    def group(self, open_: str = "{", close: str = "}") -> Value:
        self.take(open_)
        out = self.sum()
        self.take(close)
        return out

    def argument(self) -> Value:
        r"""What braces hold, or one figure or letter (``\frac12``)."""
        if self.next() == "{":
            return self.group()
        token = self.next()
        if len(token) > 1 and token.isdecimal():
            self.tokens[self.at] = token[1:]
            return Value.of(int(token[0]))
        return self.part()

    def part(self) -> Value:
        token = self.next()
        if token == "(":
            return self.group("(", ")")
        if token == "{":
            return self.group()
        if token == "[":
            return self.group("[", "]")
        if token == "|":
            return self.function("abs", self.group("|", "|"))
        self.take()
        name = token.lstrip("\\")
        if token[0].isdigit() or token[0] == ".":
            return Value.of(Fraction(int(token)) if token.isdecimal() else Fraction(token if token[-1] != "." else token[:-1]))
        if name == "frac":
            return self.argument() * self.argument().inverse()
        if name == "sqrt":
            n = self.group("[", "]") if self.next() == "[" else Value.of(2)
            return (self.group("(", ")") if self.next() == "(" else self.argument()) ** n.inverse()
        if name in FUNCTIONS:
            if self.next() == "^":
                raise Unread("a power of a function's name")
            return self.function(name, self.argument() if self.next() == "{" else self.power())
        if name in ("infty", "inf"):
            return Value.atom("inf")
        if token[0] == "\\" and name != "pi" and len(name) > 1 and name in ("text", "begin", "end"):
            raise Unread(token)
        if NAME.fullmatch(name):
            return Value.atom(name)
        raise Unread(token)

    @staticmethod
    def function(name: str, argument: Value) -> Value:
        r = argument.rational()
        if name == "abs" and r is not None:
            return Value.of(abs(r))
        return Value.atom((name, argument.key()))


@lru_cache(10_000)
def read(text: str) -> Value | None:
    try:
        return Reader(text).whole()
    except (Unread, RecursionError, OverflowError):
        return None


def same_formula(a: str, b: str, pi: float = math.pi) -> bool:
    """Equal as formulas, or as values of constants to four digits."""
    x, y = read(a), read(b)
    if x is None or y is None:
        return False
    try:
        if same_value(x, y):
            return True
    except Unread:
        pass
    u, v = x.number(pi), y.number(pi)
    return u is not None and v is not None and cmath.isfinite(u) and cmath.isfinite(v) and cmath.isclose(u, v, rel_tol=1e-4)


def number(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def parts(text: str) -> list[str]:
    """At commas outside all brackets."""
    if "," not in text:
        return [text.strip()]
    out, depth = [""], 0
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


#: Names of intervals and the brackets they stand for.
INTERVALS = {"Interval": "[]", "Interval.Ropen": "[)", "Interval.Lopen": "(]", "Interval.open": "()"}


def _cells(text: str) -> list[list[str]] | None:
    r"""Rows of a matrix in a pmatrix, ``Matrix([...])`` or nested brackets."""
    if text[:1] not in ("\\", "M", "["):
        return None
    m = re.fullmatch(r"\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}", text, re.DOTALL)
    if m:
        return [[c.strip() for c in row.split("&")] for row in re.split(r"\\\\|\\(?![A-Za-z])", m[1]) if row.strip()]
    m = re.fullmatch(r"(?:Matrix\()?\[(.*)\]\)?", text, re.DOTALL)
    rows = parts(m[1]) if m else []
    if rows and all(r[:1] == "[" and r[-1:] == "]" for r in rows):
        return [parts(r[1:-1]) for r in rows]
    return [[r] for r in rows] if m and text.startswith("Matrix") else None


def same_answer(given: str, truth: str, pi: float = math.pi) -> bool:
    """Equal as text, number (also a hundredfold or a hundredth), interval, tuple, list, matrix or formula."""
    given, truth = (_bare(x.strip()) for x in (given, truth))
    if given.lower() == truth.lower() or given.replace(" ", "") == truth.replace(" ", ""):
        return True
    a, b = number(given), number(truth)
    if a is not None and b is not None:
        return any(math.isclose(x, a, rel_tol=1e-4) for x in (b / 100, b, b * 100))
    if not given:
        return False
    m = given[0] in "IP" and re.fullmatch(r"(Interval(?:\.\w+)?|Point)\((.*)\)", given)
    if m and m[1] in (*INTERVALS, "Point"):
        given = "{0[0]}{1}{0[1]}".format(INTERVALS.get(m[1], "()"), m[2])
    rows, want = _cells(given), _cells(truth)
    if want is not None and rows is not None:
        return len(rows) == len(want) and all(len(x) == len(y) and all(same_answer(u, v, pi) for u, v in zip(x, y)) for x, y in zip(rows, want))
    closed = lambda s: s[:1] in ("(", "[") and s[-1:] in (")", "]")
    if given and truth and closed(given) != closed(truth) and (closed(given) and given[1:-1].replace(" ", "") == truth.replace(" ", "") or closed(truth) and truth[1:-1].replace(" ", "") == given.replace(" ", "")):
        return True
    if closed(given) and closed(truth) and (len(parts(given[1:-1])) > 1 or len(parts(truth[1:-1])) > 1):
        if given[0] != truth[0] or given[-1] != truth[-1]:
            return False
        given, truth = given[1:-1], truth[1:-1]
    x, y = parts(given), parts(truth)
    if len(x) > 1 or len(y) > 1:
        return len(x) == len(y) and all(same_answer(u, v, pi) for u, v in zip(x, y))
    return same_formula(given, truth, pi)


def _bare(text: str) -> str:
    r"""Without a leading $ before a number, a percent sign after one, a base (_2) after one."""
    if text[:1] == "$" and re.match(r"\$\d", text):
        return text[1:]
    if text[-1:] == "%" and re.fullmatch(r"\d+(\.\d+)?\\?%", text):
        return text.rstrip("%").rstrip("\\")
    m = "_" in text and re.fullmatch(r"(\d+)_\{?\w+\}?", text)
    return m[1] if m else text


# Units that go with a plural and a power, in this order, and what number words stand for.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
UNIT = re.compile("|".join(UNITS))
WITH_ENDINGS = [re.compile(rf"{unit}(es)?(s)? *(\^[0-9]+)?") for unit in UNITS]
WORDS = [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
#: Powers that aren't compared as formulas.
UNSAFE = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+")
THOUSANDS = re.compile(r"(?<=\d),(?=\d\d\d(?:\D|$))")
SPACED, MINUS, DEGREES, FRACTION = re.compile(r"([0-9]) +([0-9])"), re.compile("- *"), re.compile(r"\^ *\\circ"), re.compile(r"-?[0-9]+.?/0*[1-9][0-9]*.?")


def _whole(text: str) -> int | None:
    text = THOUSANDS.sub("", text) if "," in text else text
    v = number(text) if "," not in text else None
    return round(v) if v is not None and math.isfinite(v) and abs(v - round(v)) <= 1e-7 else None


def graded_text(text: str) -> str:
    """Without units, signs of money and percent, degrees; whole numbers as such; mixed numbers as sums; in lower case."""
    m = text[:6] == "\\text{" and re.search(r"^\\text\{(.+?)\}$", text)
    text = m[1] if m else text
    for before, after in WORDS:
        text = text.replace(before, after)
    if UNIT.search(text):
        for unit in WITH_ENDINGS:
            text = unit.sub("", text)
    text = DEGREES.sub("", text) if "\\circ" in text else text
    if text[:1] == "{" and text[-1:] == "}":
        text = text[1:-1]
    v = number(text) if "," not in text else None
    if v is not None and math.isfinite(v) and abs(v - round(v)) <= 1e-7:
        text = str(round(v))
    if "\\" in text:
        text = _plain(text)
    text = (SPACED.sub(r"\1+\2", MINUS.sub("-", text)) if " " in text else text).lower()
    whole = _whole(text)
    return text if whole is None else str(whole)


def _plain(text: str) -> str:
    r"""LaTeX as plain notation: a/b for \frac{a}{b}, sqrt(x), pi, * for products."""
    for before, after in SAME[:8]:
        text = text.replace(before, after)
    inner = r"\{([^{}]*)\}"
    simple = lambda s: s if re.fullmatch(r"-?[\w.]+", s) else f"({s})"
    for _ in range(20):
        made = re.sub(r"\\sqrt\[([^\]]*)\]" + inner, r"(\2)^(1/\1)", re.sub(r"\\sqrt" + inner, r"sqrt(\1)", text))
        made = re.sub(r"(\d)?\\frac" + inner + inner, lambda m: (m[1] + " " if m[1] else "") + simple(m[2]) + "/" + simple(m[3]), made)
        if made == text:
            break
        text = made
    for before, after in (("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*"), ("\\{", "{"), ("\\}", "}")):
        text = text.replace(before, after)
    return re.sub(r"\\text\{([^{}]*)\}", r"\1", text).strip()


def graded(given: str, truth: str) -> bool:
    """Equal after ``graded_text``; of the same brackets, part by part: a fraction as it stands, a whole number exactly, else as a formula of at most two letters."""
    x, y = graded_text(given), graded_text(truth)
    if x == y:
        return True
    if not x:
        return False

    def split(s: str) -> list[str]:
        s = THOUSANDS.sub("", s)
        flat = len(s) > 2 and s[0] in "()[]" and s[-1] in "()[]" and not set("()[]") & set(s[1:-1])
        return [p.strip() for p in s[1:-1].split(",")] if flat else [s]

    def same(a: str, b: str) -> bool:
        if FRACTION.fullmatch(a) and FRACTION.fullmatch(b):
            return a == b
        if (_whole(a) is None) != (_whole(b) is None):
            return False
        both = f"({b})-({a})"
        letters = set(filter(str.isalpha, both.replace("sqrt", "").replace("frac", "")))
        return len(letters) <= 2 and not UNSAFE.search(both) and same_exactly(a, b)

    a, b = split(x), split(y)
    if len(a) != len(b) or len(b) > 1 and (x[0] != y[0] or x[-1] != y[-1]):
        return False
    return all(same(u, v) for u, v in zip(a, b))


def same_exactly(a: str, b: str) -> bool:
    x, y = read(a), read(b)
    try:
        return x is not None and y is not None and same_value(x, y)
    except Unread:
        return False


@lru_cache(10_000)
def judged(given: str, truth: str) -> bool:
    """Graded part by part, or of one value."""
    pis = (math.pi, 3.14) if "\\pi" in given or "\\pi" in truth else (math.pi,)
    return graded(given, truth) or any(same_answer(given, truth, p) for p in pis)


@F.pandas_udf(BooleanType())
def _right(pairs: pd.DataFrame) -> pd.Series:
    known = pairs["known"].to_numpy()
    out, given, truth = known == 1, pairs["given"].to_numpy(), pairs["truth"].to_numpy()
    for k in (known == OPEN).nonzero()[0].tolist():
        out[k] = judged(given[k], truth[k])
    return pd.Series(out)


#: Not known without reading the formulas.
OPEN = -1
SIMPLE_FRACTION = r"\A\\frac\{([0-9]{1,15})\}\{([1-9][0-9]{0,14})\}\z"


def _known(a: Column, b: Column) -> Column:
    """1 or 0 where columns tell: nulls, equal texts and forms, plain numbers, a fraction of whole numbers with one; else ``OPEN``."""
    double = lambda v: v.try_cast("double")
    near = lambda x, y: F.abs(x - y) <= F.greatest(x, y) * 1e-4
    fraction = lambda v: F.regexp_like(v, F.lit(SIMPLE_FRACTION))
    value = lambda v: double(F.regexp_extract(v, SIMPLE_FRACTION, 1)) / double(F.regexp_extract(v, SIMPLE_FRACTION, 2))

    def numbers(x: Column, y: Column) -> Column:
        # Also a hundredfold or a hundredth. Very small ones may both be graded as 0.
        both = bound(F.struct(x.alias("x"), y.alias("y")), lambda p: F.when(near(p["y"], p["x"]) | near(p["y"] / 100, p["x"]) | near(p["y"] * 100, p["x"]), 1).when((p["x"] > 1e-6) & (p["y"] > 1e-6), 0))
        return F.coalesce(both, F.lit(OPEN))

    def mixed(x: Column, y: Column) -> Column:
        return bound(F.struct(x.alias("x"), y.alias("y")), lambda p: F.when(near(p["x"], p["y"]), 1).otherwise(0))

    out = F.when(a.isNull() | b.isNull(), 0).when(a == b, 1).when(plain_number(a) & plain_number(b), numbers(double(a), double(b)))
    out = out.when(fraction(a) & plain_number(b), mixed(value(a), double(b))).when(plain_number(a) & fraction(b), mixed(double(a), value(b)))
    return out.when(graded_form(a) == graded_form(b), 1).otherwise(OPEN)


def right_answer(given: Column, truth: Column) -> Column:
    """Whether an answer is the truth: in normal form, graded part by part, or as a value; false for nulls. Python gets only what columns leave open."""
    # Both are used several times: costly expressions should be columns of their own before.
    return _right(bound(_known(given, truth), lambda k: F.struct(k.alias("known"), F.when(k == OPEN, given).alias("given"), F.when(k == OPEN, truth).alias("truth"))))


def last_box(text: Column) -> Column:
    r"""What the last ``\boxed`` or, without one, ``\fbox`` holds in balanced braces; null if they don't close."""
    held = lambda t, mark: bound(F.substring_index(t, mark, -1), lambda r: F.when(F.contains(r, F.lit("{")), python_stripped(before_brace(F.substr(r, F.instr(r, "{") + 1)))))
    return bound(text, lambda t: F.when(F.contains(t, F.lit("\\boxed")), held(t, "\\boxed")).when(F.contains(t, F.lit("\\fbox")), held(t, "\\fbox")))


# What an answer comes after and before; and what is before it in the sentence that is left.
AFTER, BEFORE = ["answer:", "answer is", "answers are"], ["is answer", "is the answer", "are answers", "are the answers"]
LEADS = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]


#: Texts of ASCII alone: their lower case has the same places, and these are their white space.
BLANKS = " \t\n\x0b\f\r"


def _cut_after(text: Column, mark: str) -> Column:
    """What follows the mark's last place, without white space at both ends; without the mark the text as it is."""
    return F.regexp_replace(text, rf"(?isU)\A.*{mark}\s*(.*?)\s*\z", "$1")


def _cut_before(text: Column, mark: str) -> Column:
    return F.regexp_replace(text, rf"(?isU)\A\s*(.*\S)?\s*{re.escape(mark)}.*\z", "$1")


def _both(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lower(text).alias("low"))


def _ascii_cut(both: Column, mark: str, after: bool) -> Column:
    """The same of a text and its lower case, which is made once and cut at the same places."""

    def cut(s: Column) -> Column:
        rest = F.length(F.substring_index(s["low"], mark, -1))
        side = lambda t: F.btrim(F.substr(t, F.length(t) - rest + 1) if after else F.substr(t, F.lit(1), F.length(t) - rest - len(mark)), F.lit(BLANKS))
        return F.struct(side(s["text"]).alias("text"), side(s["low"]).alias("low"))

    return bound(both, lambda s: F.when(F.contains(s["low"], F.lit(mark)), cut(s)).otherwise(s))


def stated_answer(text: Column) -> Column:
    """The answer that a text states: after and before its marks, boxed, of the last sentence but what follows a full stop."""

    def marked(t: Column, after, before) -> Column:
        for mark in AFTER:
            t = after(t, mark)
        for mark in BEFORE:
            t = before(t, mark)
        return t

    def led(t: Column, after, before) -> Column:
        t = before(t, ". ")
        for lead in LEADS:
            t = after(t, lead)
        return t

    unboxed = lambda t: bound(last_box(t), lambda box: F.when(box != "", box))
    ways = (lambda s, mark: _ascii_cut(s, mark, True)), (lambda s, mark: _ascii_cut(s, mark, False))

    def plain(v: Column) -> Column:
        # All marks before the box hold the word.
        out = bound(_both(v), lambda s: F.when(F.contains(s["low"], F.lit("answer")), marked(s, *ways)).otherwise(s))
        out = bound(out, lambda s: bound(unboxed(s["text"]), lambda box: F.when(box.isNotNull(), _both(box)).otherwise(s)))
        return led(out, *ways)["text"]

    def other(v: Column) -> Column:
        out = bound(marked(v, _cut_after, _cut_before), lambda t: F.coalesce(unboxed(t), t))
        return led(out, _cut_after, _cut_before)

    return bound(text, lambda v: F.when(F.octet_length(v) == F.length(v), plain(v)).otherwise(other(v)))
