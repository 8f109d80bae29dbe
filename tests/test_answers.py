r"""Answer forms by their rules in plain Python on made texts, and equality of formulas."""

import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import answers as A
from tracewright.functions import scoring as S
from tracewright.functions import symbolic as Y


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


FINAL = [
    ("12 ways", "12"), ("3 km", "3"), ("5.0", "5.0"), ("50%", "50%"), ("9 miles", "9miles"), ("x = 7", "7"), ("1,234", "1234"), ("1,2a", "1,2a"), ("$1{,}000$", "1000"), (r"\frac12", r"\frac{1}{2}"), (r"\frac123", r"\frac{1}{2}3"),
    (r"\sqrt3", r"\sqrt{3}"), (r"\text{3 m}", "3m"), ("see $x$ and $y$", "x"), (r"\boxed{4} cm", "4"), ("an apple", "apple"), (r"5\text{m}^2", "5"), (r"90^\circ", "90"), ("", ""), (None, None), ("= \n 8 ", "8"), (r"\textbf{C}", "C"), (r"\mbox{no}", "no"),
]


def test_final_form(spark):
    assert column(spark, [x for x, _ in FINAL], A.final_form) == [y for _, y in FINAL]


#: What a verdict found wrong: answers that score 1 and -1.
SCORED = [("Answer: 12 ways", "12", 1.0), ("answer : 3 km", "3", 1.0), ("Answer: 5.0", "5", -1.0), ("Answer: 50%", "50", -1.0), ("Answer: 9 miles", "9", -1.0), ("Answer: 2\nAnswer: $\\frac12$", r"\frac{1}{2}", 1.0), ("nothing", "[INVALID]", 1.0), ("12", "12", -1.0)]


def test_scores_of_lines(spark):
    df = spark.createDataFrame(SCORED, "said string, truth string, score double")
    assert [(r.s, r.score) for r in df.select("score", S.math_dapo_score(F.col("said"), F.col("truth")).alias("s")).collect()] == [(x, x) for *_, x in SCORED]


BOXED = [
    (r"\dfrac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac{72}1", r"\frac{72}1"), ("0.5", r"\frac{1}{2}"), (".5", r"\frac{1}{2}"), ("1/2", r"\frac{1}{2}"), ("-3/4", r"\frac{-3}{4}"), ("03/4", "03/4"), ("1/2/3", "1/2/3"), ("k = 3", "3"), ("abc=3", "abc=3"),
    (r"5\text{ cm}", "5"), (r"5\text{ a}\text{ b}", None), (r"\sqrt2x", r"\sqrt{2}x"), (r"\sqrt", None), (r"\frac", None), (r"\frac1", r"\frac1"), (r"\frac1\frac23", r"\frac1\frac23"), (r"\frac\frac23", None), (r"10\%", "10"), (r"\left( 1 , 2 \right)", "(1,2)"), ("", ""), (None, None), (r"90^{\circ}", "90"),
    ("x=1=2", "x=1=2"), (r"\frac\pi2", r"\frac{\}{p}i2"),
]


def test_boxed_form(spark):
    assert column(spark, [x for x, _ in BOXED], A.boxed_form) == [y for _, y in BOXED]


def test_graded_form(spark):
    rows = [(r" \text{Tuesday } ", "Tuesday"), (r"\text{a}b", r"\text{a}b"), (r"5\text{ a}\text{ b}", r"5\text{ a}\text{ b}"), (" .5 ", r"\frac{1}{2}"), (None, None)]
    assert column(spark, [x for x, _ in rows], A.graded_form) == [y for _, y in rows]


def test_same_boxed(spark):
    rows = [("1/2", r"\frac12", True), (None, None, True), (None, "1", False), (r"\sqrt", r"\sqrt", True), (r"\sqrt", "2", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    assert all(r[0] == r[1] for r in df.select("same", A.same_boxed(F.col("a"), F.col("b"))).collect())


VALUES = [
    ("0.5", r"\frac{1}{2}", True), (r"\sqrt{12}", r"2\sqrt{3}", True), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}", True), ("(x+1)^2", "x^2+2x+1", True), (r"\frac{x^2-1}{x-1}", "x+1", True), ("x+y", "x-y", False), ("[1,2)", "[1, 2)", True),
    ("[1,2)", "(1,2)", False), ("Interval.open(0,1)", "(0,1)", True), ("Interval.Lopen(0, 1)", "(0,1]", True), (r"(1,\frac12)", "(1,0.5)", True), ("1,2,3", "1, 2, 3", True), ("1,2", "1,2,3", False), ("Point(1,2)", "(1,2)", True),
    ("Matrix([[1,2],[3,4]])", r"\begin{pmatrix} 1 & 2 \\ 3 & \frac{8}{2} \end{pmatrix}", True), ("[[1],[2]]", r"\begin{pmatrix}1\\2\end{pmatrix}", True), ("[[1],[2]]", r"\begin{pmatrix}1&2\end{pmatrix}", False), (r"50\%", "0.5", True), ("$5", "5", True),
    (r"2\pi", "6.2832", True), (r"\sin(\pi/6)", "1/2", True), (r"\sqrt{x+1}\sqrt{x+1}", "x+1", True), (r"\sqrt{x^2}", "x", False), ("2^{10}", "1024", True), ("i^2", "-1", True), (r"\sqrt{-4}", "2i", True), (r"\sqrt[3]{-8}", "-2", True),
    (r"1\frac{1}{2}", "3/2", True), ("5!", "120", True), ("|-3|", "3", True), (r"(-\infty,2]", r"(-\infty, 2]", True), ("x^{-1}", "1/x", True), (r"\frac{a}{b}+\frac{c}{d}", r"\frac{ad+bc}{bd}", True), ("e^{2x}", "e^{x}", False), ("1/0", "2", False), ("", "0", False),
    ("9^{999999}", "3", False), ("(" * 900, "1", False), ("1,000", "1000", True), ("101_2", "101", True), (r"\sqrt{6}", r"\sqrt{2}\sqrt{3}", True), ("(x+y+z)^{60}", "(x+y+z)^{60}+1", False), ("(1,2)", "1,2", True), ("\ud800", "x", False),
]


@pytest.mark.parametrize(("a", "b", "same"), VALUES)
def test_values(a, b, same):
    assert Y.same_answer(a, b) is same


GRADED = [("1/2", r"\frac{1}{2}", True), ("2/4", "1/2", False), ("5.0", "5", True), ("3 miles", "3", True), ("x+1", "1+x", True), ("(1,2)", "(2,1)", False), ("7 3/4", r"7\frac{3}{4}", True), ("1,234", "1234", True), ("5", "5.1", False), ("sqrt(8)", "2*sqrt(2)", True), ("x^{2}", "x*x", False), ("a+b+c", "c+b+a", False)]


@pytest.mark.parametrize(("a", "b", "same"), GRADED)
def test_grades(a, b, same):
    assert Y.graded(a, b) is same


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.integers(-9, 9).map(str) | st.sampled_from("xy"), lambda e: st.tuples(e, st.sampled_from("+-*/"), e).map(lambda t: f"({t[0]}{t[1]}{t[2]})") | e.map(lambda x: f"({x})^2"), max_leaves=7))
def test_formulas_agree_with_fractions(text):
    """An expression equals its value's own expression at no point but where both have one."""
    value = Y.read(text)

    def at(x, y):
        python = re.sub(r"(\d+)", r"Fraction(\1)", text.replace("^2", "**two"))
        return eval(python, {"Fraction": Fraction, "x": Fraction(x), "y": Fraction(y), "two": 2})

    if value is None:  # a division by what is always zero
        return
    one = lambda s: sum((c * x**k.get("x", 0) * y ** k.get("y", 0) for m, c in s.items() for k in [{a: int(n) for a, n in m}]), Fraction(0))
    for x, y in ((Fraction(3, 7), Fraction(5, 11)), (Fraction(-2, 3), Fraction(13, 5))):
        try:
            assert one(value.top) == at(x, y) * one(value.bottom)
        except ZeroDivisionError:
            pass


def test_stated_and_right_answers(spark):
    said = [("So the answer is: 7.", "7."), (r"Answer: \boxed{\frac{1}{2}} ok", r"\frac{1}{2}"), ("it follows that x = 3. Thanks", "3"), ("12 is the answer", "12"), (r"\boxed{open", r"\boxed{open"), (r"\fbox{3}", "3"), ("", ""), (None, None), ("we get 4", "4")]
    assert column(spark, [x for x, _ in said], Y.stated_answer) == [y for _, y in said]
    rows = [(r"\text{Tuesday}", "Tuesday", True), (r"2\pi", "6.28", True), (r"2\pi", "6.283185", True), ("3.", "3", True), (None, "1", False), ("1", None, False), ("", "1", False), ("2/4", "1/2", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", Y.right_answer(F.col("a"), F.col("b"))).collect())
    boxes = [(r"\boxed{a{b}} \boxed{c}", "c"), (r"\fbox{x}", "x"), (r"\boxed }", None), (r"\boxed{", None), (None, None), (r"\boxed {y}", "y")]
    assert column(spark, [x for x, _ in boxes], Y.last_box) == [y for _, y in boxes]


def test_numbers_are_read_without_products_of_terms(monkeypatch):
    # Most answers are numbers or short sums: reading one costs no product of sums, term by term.
    from tracewright.functions import symbolic

    made = []
    monkeypatch.setattr(symbolic, "product", lambda *x: made.append(x) or [(i, j) for i in x[0] for j in x[1]])
    symbolic.read.cache_clear()
    assert symbolic.same_answer("1234.5", r"\frac{2469}{2}") and symbolic.same_answer("x+77", "77 + x") and not symbolic.graded("8", r"\frac{7}{2}") and not made
    assert symbolic.same_answer("(x+1)(x+2)", "x^2+3x+2") and made


def python_free(df):
    return "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_plain_numbers_and_fractions_are_judged_as_columns(spark):
    from tracewright.functions import text

    pairs = [("12", "12.0"), ("12", "25"), ("50", "0.5"), ("50.005", "50"), ("50.0051", "50"), (r"\frac{25}{2}", "12.5"), ("12.5", r"\frac{25}{2}"), (r"\frac{25}{2}", "12.6"), (r"\frac{1}{2}", "50"), ("True", "True"), ("0.5", r"\frac12")]
    df = spark.createDataFrame(pairs, "a string, b string")
    known = df.select("a", "b", Y._known(F.col("a"), F.col("b")).alias("k"))
    assert python_free(known) and all(r["k"] == Y.judged(r["a"], r["b"]) for r in known.collect())
    left = [("x+1", "1+x"), ("0.00000001", "0.00000004"), (r"\frac{1}{0}", "1")]
    assert {r[0] for r in spark.createDataFrame(left, "a string, b string").select(Y._known(F.col("a"), F.col("b"))).collect()} == {Y.OPEN}
    nested = spark.createDataFrame([(r"a \boxed{1} \boxed{a{b{c{d}}}}e}",), (r"\boxed{a{b}",), ("none",), (None,)], "t string").coalesce(1).select(text.boxed("t"))
    assert python_free(nested) and [r[0] for r in nested.collect()] == ["a{b{c{d}}}", None, None, None]
    assert not Y.same_answer("(1, 2)", "")  # an empty truth has no first bracket


def test_stated_answers_need_no_python(spark):
    said = [("The answer is Answer: [3, 4) ", "[3, 4)"), ("so x = 5. Done", "5"), ("The ANSWER IS \\boxed{\\frac{1}{2}} ok", "\\frac{1}{2}"), ("é the answer is 5", "5"), ("12 is the answer", "12"), (" as it is not ", "not"), ("", "")]
    df = spark.createDataFrame(said, "t string, want string").select("want", Y.stated_answer(F.col("t")).alias("got"))
    assert python_free(df) and all(r["got"] == r["want"] for r in df.collect())
