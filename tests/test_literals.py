"""Odd and plain cases of the parsers and rules, one by one."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import scoring as S
from tracewright.functions import text as T
from tracewright.plans.scores import _call

M, D = "mobile_use", "computer_use"
BOX, FAR = [0.0, 0.0, 100.0, 100.0], [200.0, 200.0, 300.0, 300.0]
# (label, answer, box, box2, share, score): each rule with a full, a partial and an unreadable answer.
CASES = [
    (_call(M, action="click", coordinate=[5, 5]), _call(M, action="click", coordinate=[100, 0]), BOX, None, 1.0, 1.0),
    (_call(M, action="click", coordinate=[5, 5]), _call(M, action="click", coordinate=[5, 5]), None, None, 1.0, 1.0),
    (_call(M, action="click", coordinate=[5, 5]), _call(M, action="click", coordinate=[101, 5]), BOX, None, 0.5, -0.5),
    (_call(M, action="click", coordinate=[5, 5]), _call(M, action="click"), BOX, None, 0.5, -0.5),
    (_call(M, action="long_press", coordinate=[5, 5]), _call(M, action="click", coordinate=[5, 5]), BOX, None, 0.5, -0.5),
    (_call(M, action="swipe", coordinate=[5, 5], coordinate2=[250, 250]), _call(M, action="swipe", coordinate=[9, 9], coordinate2=[299, 201]), BOX, FAR, 1.0, 1.0),
    (_call(M, action="swipe", coordinate=[5, 5], coordinate2=[250, 250]), _call(M, action="swipe", coordinate=[9, 9], coordinate2=[9, 9]), BOX, FAR, 2 / 3, -0.5),
    (_call(M, action="type", text=" Hello"), _call(M, action="type", text="hello "), None, None, 1.0, 1.0),
    (_call(M, action="answer"), _call(M, action="answer", text=""), None, None, 1.0, 1.0),
    (_call(M, action="system_button", button="Back"), _call(M, action="system_button", button="Home"), None, None, 0.5, -0.5),
    (_call(M, action="system_button"), _call(M, action="system_button"), None, None, 1.0, 1.0),
    (_call(M, action="wait"), _call(M, action="wait", time=9), None, None, 1.0, 1.0),
    (_call(M, action="terminate", status="success"), _call(M, action="terminate", status="failure"), None, None, 0.5, -0.5),
    (_call(D, action="left_click", coordinate=[5, 5]), _call(D, action="left_click", coordinate=[1, 1]), BOX, None, 1.0, 1.0),
    (_call(D, action="left_click_drag", coordinate=[5, 5]), _call(D, action="left_click_drag", coordinate=[500, 1]), BOX, None, 0.5, -0.5),
    (_call(D, action="key", keys=["Ctrl", "c"]), _call(D, action="key", keys=["C", "ctrl", "ctrl"]), None, None, 1.0, 1.0),
    (_call(D, action="scroll", pixels=-5, coordinate=[5, 5]), _call(D, action="scroll", pixels=-1, coordinate=[6, 6]), BOX, None, 1.0, 1.0),
    (_call(D, action="scroll", pixels=-5, coordinate=[5, 5]), _call(D, action="scroll", pixels=1, coordinate=[6, 6]), BOX, None, 2 / 3, -0.5),
    (_call(D, action="hscroll", pixels=0), _call(D, action="hscroll"), None, None, 2 / 3, -0.5),
    (_call(M, action="ask_user", text="x"), _call(M, action="ask_user", text="x"), None, None, None, -1.0),
    (_call("other", action="click"), _call("other", action="click"), None, None, None, -1.0),
    (_call(M, action="wait"), "no call", None, None, 0.0, -1.0),
    (_call(M, action="wait"), "<tool_call>{bad</tool_call>", None, None, 0.0, -1.0),
    (_call(M), _call(M, action="wait"), None, None, None, -1.0),
]


def column(spark, texts, make, schema="string"):
    df = spark.createDataFrame(list(enumerate(texts)), f"i int, t {schema}")
    return [r[1] for r in df.select("i", make(F.col("t"))).orderBy("i").collect()]


def test_reward_rules(spark):
    c = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, truth string, response string, box array<double>, box2 array<double>")
    share = S.part_share(T.tool_call(F.col("response")), T.tool_call(F.col("truth")), F.col("box"), F.col("box2"))
    whole = S.compute_score(F.col("response"), F.col("truth"), F.col("box"), F.col("box2"))
    got = c.select("i", F.round(share, 6).alias("share"), whole.alias("w")).orderBy("i").collect()
    for r, (*_, want, score) in zip(got, CASES):
        assert (r.share is None if want is None else abs(r.share - want) < 1e-6) and r.w.score == score and r.w.acc == float(score == 1), r


ODD = [
    ("pyautogui.click(1.5, 2)", "left_click", None, None, None), ("pyautogui.click()", "left_click", None, None, None), ("unknown()", "left_click", None, None, None),
    ("FAIL", "terminate", None, None, None), ("WAIT", "wait", None, None, 5.0), ("pyautogui.scroll(-3.7, 960, 540)", "scroll", "500,500", None, None),
    ('pyautogui.write(message=\'it "is"\')', "type", None, 'it "is"', None), ('pyautogui.typewrite("""a "b" c""")', "type", None, 'a "b" c', None), ('pyautogui.typewrite("""a\nb""")', "type", None, "", None),
    ("pyautogui.sleep()", "wait", None, None, 0.5), ("pyautogui.click(0, 0)\npyautogui.typewrite('x')\npyautogui.keyDown('enter')\npyautogui.keyUp('enter')", "type", None, "x", None),
    ("# note\npyautogui.rightClick(1920, 1080)", "right_click", "999,999", None, None), ("# only\n# notes", "wait", None, None, 1.0),
]


def test_odd_actions(spark):
    got = column(spark, [r[0] for r in ODD], lambda c: T.action_plan(c))
    place = lambda p: p and ",".join(str(int(v)) for v in p)
    assert [(p.action, place(p.coordinate), p.text, p.time) for p in got] == [tuple(r[1:]) for r in ODD]


TEXTS = [
    ("Thought:  look here \nAction: {\"action_type\": \"click\"} ", "look here", '{"action_type": "click"}', "{\"action_type\": \"click\"}"),
    ("no thought {\"a\": 1} tail", "", '{"a": 1}', ""),
    ("Action: go\n\nmore", "", "", "go"),
    ("## Action:\nTap it.\n## Next\nx", "", "", "Tap it."),
    ("Action: press<tool_call>{}</tool_call>", "", "{}", "press"),
    ("plain", "", "", ""),
]


def test_predictions(spark):
    assert [(p.thought, p.raw) for p in column(spark, [r[0] for r in TEXTS], T.prediction)] == [r[1:3] for r in TEXTS]
    assert column(spark, [r[0] for r in TEXTS], T.action_description) == [r[3] for r in TEXTS]


BOXED = [('{"bbox": [1, 2, 3, 4]}', "1,2,3,4", "1,2,3,4"), ("box 10 20 1000 40 50", "10,20,1000,40", "10,20,999,40"), ("-5 2 3 4", "-5,2,3,4", None), ("1 2 3", None, None), ('{"bbox": [0.5, 1.5, 2.5, 1001]}', "0,2,2,1001", None)]


def test_boxes(spark):
    show = lambda b: b and ",".join(map(str, b))
    assert [show(b) for b in column(spark, [r[0] for r in BOXED], T.box_numbers)] == [r[1] for r in BOXED]
    assert [show(b) for b in column(spark, [r[0] for r in BOXED], lambda c: T.clamped_box(T.box_numbers(c)))] == [r[2] for r in BOXED]


TAGS = [("<answer>x</answer> <answer> y </answer>", "y", 2), ("none", None, 0), ("<answer>\n</answer>", "", 1), ("<answer>open", None, 0)]


def test_answer_tags(spark):
    assert column(spark, [r[0] for r in TAGS], T.answer_tag) == [r[1] for r in TAGS]


MESSAGES = [("plain", True), ("<think>a</think> b", True), ("<think></think>b", False), ("<think>a</think>", False), ("<think>a b", False), ("</think>a<think>b", False), ("<think>a</think><think>b</think>c", False), ("<think>a</think>b<|im_end|>", True), ("<|im_end|>", False)]


def test_messages(spark):
    assert column(spark, [r[0] for r in MESSAGES], T.valid_message) == [r[1] for r in MESSAGES]


PYTHON = [(r"so \boxed{\frac{1}{2}} and \boxed{a{b}c}", "a{b}c", None, None, False), ("```json\n{\"b\": 1, \"a\": {\"c\": 2}}\n```", None, '{"b": 1, "a": {"c": 2}}', None, False), ('{"b":1,"a":2}', None, '{"b": 1, "a": 2}', '{"a": 2, "b": 1}', False), (r"\boxed{open", None, None, None, False), ("ab" * 40, None, None, None, True)]


def test_python_text(spark):
    for k, f in enumerate((T.boxed, T.first_json, T.canonical_json, T.is_repetitive), 1):
        assert column(spark, [r[0] for r in PYTHON], f) == [r[k] for r in PYTHON]


def test_first_json_looks_on_after_what_is_none():
    first = T._first_json
    assert first(None) is None and first("") is None and first("{") is None
    assert first('{not "} then {"a": 1}') == '{"a": 1}'
    assert first('{"a": {"b": 1}, bad {"c": 2}') == '{"b": 1}'
    assert first('{"a": "open {"c": 2}') == '{"c": 2}'
    assert first('{"a": ' * 5 + '{"b": 2} , x') == '{"b": 2}'
    assert first("{" * 200_000) is None and first('{"a":' * 100_000) is None
    assert first('{"a":[' * 300 + '{"z": 1}') == '{"z": 1}'


def test_gsm8k_has_one_space(spark):
    texts = ["#### 5", "####5", "####\n5", "####  5", "x #### -1,234.5 and #### 7", "no", "#### $5"]
    assert column(spark, texts, T.gsm8k_strict) == ["5", None, None, None, "7", None, None]
    assert column(spark, [".", "none", "3 ."], T.gsm8k_flexible) == [".", None, "3"]


def shared(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    total = 0
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        total += k
    return total * 2 / (len(text) * (len(text) + 1)) if len(text) > 1 else 0.0


@settings(max_examples=100, deadline=None)
@given(st.text("abé😀", max_size=60))
def test_repeatness(text):
    assert abs(T.repeatness(text) - shared(text)) < 1e-12


def test_repeatness_takes_whole_suffixes():
    rng = np.random.default_rng(0)
    block = "".join(rng.choice(list("abcdefgh"), 560))
    text = block * 6 + "X" + block[1:] + block * 5
    assert abs(T.repeatness(text) - shared(text)) < 1e-12 and T.repeatness(text) > 0.2
    assert T.repeatness("a" * 30_000) > 0.99 and T.repeatness("".join(rng.choice(list("abcdefgh"), 30_000))) < 0.01


TRIPLES = [("<think>t\n</think>\nAction: do it\n<tool_call>\n{\"name\": \"m\"}\n</tool_call>", "t", "do it", '{"name": "m"}'), ("nothing", None, "", None)]


def test_triples(spark):
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    texts = [x[0] for x in TRIPLES]
    assert column(spark, texts, lambda c: strip(T.found(c, r"(?s)<think>(.*?)</think>"))) == [x[1] for x in TRIPLES]
    assert column(spark, texts, T.action_description) == [x[2] for x in TRIPLES]
    assert column(spark, texts, lambda c: strip(T.found(c, T.TOOL_CALL))) == [x[3] for x in TRIPLES]
