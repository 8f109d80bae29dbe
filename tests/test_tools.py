import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import tools


def calls(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return sorted([(r.i, r.place, r["name"], r.arguments, r.error is not None) for r in tools.tool_calls(df, **how).collect()], key=str)


def test_marked(spark):
    one = lambda name, arguments: "<tool_call>" + json.dumps({"name": name, "arguments": arguments}) + "</tool_call>"
    texts = [None, "", "none", "<tool_call>{}", "</tool_call><tool_call>", one("a", {"x": 1}) + one("b", None), "x<tool_call>[1]</tool_call>" + one("c", "é</tool"), '<tool_call>{"name": "d"}</tool_call>', '<tool_call>{"name": 1, "arguments": 2}</tool_call>', one("e", "</tool_call>"), "<tool_call>" + "[" * 20_000 + "</tool_call>"]
    want = [(5, 0, "a", '{"x": 1}', False), (5, 1, "b", "null", False), (6, 0, None, None, True), (6, 1, "c", '"é</tool"', False), (7, 0, None, None, True), (8, 0, None, None, True), (9, 0, None, None, True), (10, 0, None, None, True)]
    assert calls(spark, texts) == sorted(want, key=str)
    left = calls(spark, texts[:6], how="left")
    assert [x for x in left if x[0] < 5] == [(i, None, None, None, False) for i in range(5)]


def test_channels(spark):
    call = "<|start|>assistant<|channel|>commentary to=functions.%s <|constrain|>json<|message|>%s<|call|>"
    thought = "<|channel|>analysis<|message|>hm " + call % ("no", "{}") + "<|end|>"
    texts = [thought + call % ("f", "{not json"), "<|start|>assistant" + thought + "\n" + call % ("g.h", "{}\n") + call % ("i", ""), call[:-8] % ("open", "{}")]
    assert calls(spark, texts, grammar="channels") == [(0, 0, "f", "{not json", False), (1, 0, "g.h", "{}\n", False), (1, 1, "i", "", False)]
    df = spark.createDataFrame([(t + "<p>",) for t in texts[:2]], "t string")
    assert [r[0] for r in df.select(tools.content(F.col("t"), "channels", "<p>")).collect()] == ["", "\n"]


def test_own_grammar_and_names_that_clash(spark):
    @tools.grammar("words")
    def words(text):
        for w in text.split():
            yield w, None, None

    try:
        df = spark.createDataFrame([("a b", 1, 2, 3), (None, 4, 5, 6)], "`my.text` string, Place int, `x.y` int, _0 int")
        out = tools.tool_calls(df, "my.text", "words", how="left")
        assert out.columns == ["my.text", "x.y", "_0", "place", "name", "arguments", "error"]
        assert sorted([tuple(r) for r in out.collect()], key=str) == [("a b", 2, 3, 0, "a", None, None), ("a b", 2, 3, 1, "b", None, None), (None, 5, 6, None, None, None, None)]
        tools.register_tool_calls(spark, "calls_now")
        assert spark.sql("SELECT c.name FROM VALUES ('x y z') t(s), LATERAL calls_now(s, 'words') c").count() == 3
    finally:
        del tools.GRAMMARS["words"]
    with pytest.raises(ValueError, match="channels, marked"):
        tools.tool_calls(df, "my.text", "words")


def test_plan_is_one_lateral_step(spark):
    df = spark.createDataFrame([("a",)], "text string")
    plan = tools.tool_calls(df)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPythonUDTF" in plan and "Exchange" not in plan
