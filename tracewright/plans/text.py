"""Queries of text parsing, geometry and the GUI scorer's inputs."""

from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import answers as A
from tracewright.functions import symbolic as Y
from tracewright.functions import text as T
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X


# Desktop actions made from line items: ten kinds, whose plans are known from their numbers.
ACTION = r"""CASE (l_orderkey + l_linenumber) % 10
 WHEN 0 THEN format_string('pyautogui.click(%d, %d)', x, y) WHEN 1 THEN format_string('pyautogui.doubleClick(%d, %d)', x, y)
 WHEN 2 THEN format_string('pyautogui.moveTo(%d, %d)\npyautogui.scroll(-%d)', x, y, l_linenumber) WHEN 3 THEN format_string('pyautogui.typewrite("part %d")', x)
 WHEN 4 THEN "pyautogui.hotkey('ctrl', 'c')" WHEN 5 THEN "pyautogui.press('enter')"
 WHEN 6 THEN "pyautogui.keyDown('ctrl')\npyautogui.keyDown('v')\npyautogui.keyUp('v')\npyautogui.keyUp('ctrl')"
 WHEN 7 THEN format_string('pyautogui.moveTo(%d, %d)\npyautogui.dragTo(%d, %d)', x, y, y, x) WHEN 8 THEN 'time.sleep(1.5)' ELSE 'DONE' END"""


def desktop_actions(spark, d):
    line = X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 1000).cast("int").alias("x"), (F.col("l_suppkey") * 9 % 1000).cast("int").alias("y"))
    return line.withColumn("action", F.expr(ACTION))


NUMBERS = "n AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 1000)::INT AS x, (l_suppkey * 9 % 1000)::INT AS y, (l_orderkey + l_linenumber) % 10 AS k FROM lineitem)"


@query(f"""WITH {NUMBERS} SELECT l_orderkey, l_linenumber, l_partkey,
 CASE k WHEN 0 THEN 'left_click' WHEN 1 THEN 'double_click' WHEN 2 THEN 'scroll' WHEN 3 THEN 'type' WHEN 4 THEN 'key' WHEN 5 THEN 'key' WHEN 6 THEN 'key' WHEN 7 THEN 'left_click_drag' WHEN 8 THEN 'wait' ELSE 'terminate' END AS action,
 CASE WHEN k IN (0, 1, 2) THEN round_even(x * 999 / 1920.0, 0)::INT || ',' || round_even(y * 999 / 1080.0, 0)::INT WHEN k = 7 THEN round_even(y * 999 / 1920.0, 0)::INT || ',' || round_even(x * 999 / 1080.0, 0)::INT END AS place,
 CASE WHEN k = 7 THEN round_even(x * 999 / 1920.0, 0)::INT || ',' || round_even(y * 999 / 1080.0, 0)::INT END AS start_place,
 CASE WHEN k = 2 THEN -l_linenumber END AS pixels, CASE WHEN k = 3 THEN 'part ' || x END AS text,
 CASE k WHEN 4 THEN 'ctrl+c' WHEN 5 THEN 'enter' WHEN 6 THEN 'ctrl+v' END AS keys, CASE WHEN k = 8 THEN 1.5 END::DOUBLE AS seconds, CASE WHEN k = 9 THEN 'success' END AS status FROM n""")
def fn_action_to_plan(spark, d):
    a = desktop_actions(spark, d).withColumn("p", T.action_plan(F.col("action")))
    at = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")
    return a.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("p.action").alias("action"), at("p.coordinate").alias("place"), at("p.start_coordinate").alias("start_place"),
        F.col("p.pixels").cast("int").alias("pixels"), F.col("p.text").alias("text"), F.array_join("p.keys", "+").alias("keys"), F.col("p.time").alias("seconds"), F.col("p.status").alias("status"),
    )


# Recorded actions outside the plain forms, made from a line's numbers.
ODD = r'''CASE (l_orderkey + l_linenumber) % 13
 WHEN 0 THEN format_string('pyautogui.click(1.5, %d)', y) WHEN 1 THEN 'pyautogui.click()' WHEN 2 THEN format_string('unknown(%d)', x) WHEN 3 THEN 'FAIL' WHEN 4 THEN 'WAIT'
 WHEN 5 THEN format_string('pyautogui.scroll(-3.7, %d, %d)', x, y) WHEN 6 THEN format_string("pyautogui.write(message='it \"%d\"')", x)
 WHEN 7 THEN format_string('pyautogui.typewrite("""a "%d" c""")', x) WHEN 8 THEN format_string('pyautogui.typewrite("""a\n%d""")', x) WHEN 9 THEN 'pyautogui.sleep()'
 WHEN 10 THEN format_string("pyautogui.click(0, 0)\npyautogui.typewrite('%d')\npyautogui.keyDown('enter')\npyautogui.keyUp('enter')", x)
 WHEN 11 THEN '# note\npyautogui.rightClick(1920, 1080)' ELSE '# only\n# notes' END'''


@query(f"""WITH {NUMBERS}, o AS (SELECT *, (l_orderkey + l_linenumber) % 13 AS c FROM n) SELECT l_orderkey, l_linenumber, l_partkey,
 CASE WHEN c IN (0, 1, 2) THEN 'left_click' WHEN c = 3 THEN 'terminate' WHEN c IN (4, 9, 12) THEN 'wait' WHEN c = 5 THEN 'scroll' WHEN c = 11 THEN 'right_click' ELSE 'type' END AS action,
 CASE WHEN c = 5 THEN round_even(x * 999 / 1920.0, 0)::INT || ',' || round_even(y * 999 / 1080.0, 0)::INT WHEN c = 11 THEN '999,999' END AS place,
 CASE c WHEN 6 THEN 'it "' || x || '"' WHEN 7 THEN 'a "' || x || '" c' WHEN 8 THEN '' WHEN 10 THEN x::VARCHAR END AS text,
 CASE c WHEN 4 THEN 5.0 WHEN 9 THEN 0.5 WHEN 12 THEN 1.0 END::DOUBLE AS seconds FROM o""")
def fn_action_to_plan_odd(spark, d):
    a = desktop_actions(spark, d).withColumn("p", T.action_plan(F.expr(ODD)))
    place = F.array_join(F.transform("p.coordinate", lambda v: v.cast("int").cast("string")), ",")
    return a.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p.action").alias("action"), place.alias("place"), F.col("p.text").alias("text"), F.col("p.time").alias("seconds"))


@query(f"WITH {NUMBERS} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 3 THEN 'tap(' || x || ')|swipe' ELSE '' END AS unknown FROM n")
def flt_action_space(spark, d):
    a = desktop_actions(spark, d)
    a = a.withColumn("action", F.when(F.col("action").startswith("pyautogui.typewrite"), F.concat(F.lit("tap("), F.col("x").cast("string"), F.lit(")\n# ok\npyautogui.click(1, 2)\nswipe"))).otherwise(F.col("action")))
    return a.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(T.unknown_lines(F.col("action")), "|").alias("unknown"))


KIND = "element_at(array('click', 'long_press', 'input_text', 'scroll', 'drag', 'navigate_back', 'navigate_home', 'keyboard_enter', 'wait', 'status', 'answer', 'ask_user', 'fling'), cast(event_id % 13 as int) + 1)"
DUCK_KIND = "['click', 'long_press', 'input_text', 'scroll', 'drag', 'navigate_back', 'navigate_home', 'keyboard_enter', 'wait', 'status', 'answer', 'ask_user', 'fling'][(event_id % 13)::INT + 1]"


def _mobile(spark, d):
    e = X.read(spark, d, "events")
    return e.select("event_id", F.expr(KIND).alias("kind"), F.floor("value").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("event_type").alias("text"), F.when(F.col("user_id") % 2 == 0, "complete").otherwise("infeasible").alias("status"))


@query(f"""WITH m AS (SELECT event_id, {DUCK_KIND} AS kind, floor(value)::INT AS x, user_id AS y, event_type AS text FROM events)
SELECT event_id, CASE kind WHEN 'input_text' THEN 'type' WHEN 'status' THEN 'terminate' WHEN 'drag' THEN 'swipe' WHEN 'scroll' THEN 'swipe' WHEN 'fling' THEN NULL WHEN 'navigate_back' THEN 'system_button' WHEN 'navigate_home' THEN 'system_button' WHEN 'keyboard_enter' THEN 'system_button' ELSE kind END AS action,
 CASE WHEN kind IN ('click', 'long_press') THEN x || ',' || y END AS place, CASE WHEN kind IN ('input_text', 'answer', 'ask_user') THEN text END AS text,
 CASE kind WHEN 'navigate_back' THEN 'Back' WHEN 'navigate_home' THEN 'Home' WHEN 'keyboard_enter' THEN 'Enter' END AS button,
 CASE WHEN kind = 'status' THEN CASE WHEN y % 2 = 0 THEN 'success' ELSE 'failure' END END AS status, kind IN ('click', 'long_press', 'input_text', 'scroll', 'drag', 'navigate_back', 'navigate_home', 'keyboard_enter', 'wait', 'status', 'answer', 'ask_user') AS valid FROM m""")
def fn_map_mobile_action(spark, d):
    m = _mobile(spark, d)
    m = m.withColumn("p", T.mobile_plan(*[F.col(c) for c in ("kind", "x", "y", "text", "status")]))
    place = F.array_join(F.transform("p.coordinate", lambda v: v.cast("int").cast("string")), ",")
    return m.select("event_id", F.col("p.action").alias("action"), place.alias("place"), F.col("p.text").alias("text"), F.col("p.button").alias("button"), F.col("p.status").alias("status"), F.col("kind").isin(*T.MOBILE_TYPES).alias("valid"))


@query(f"""WITH m AS (SELECT event_id, {DUCK_KIND} AS kind, floor(value)::INT AS x, user_id AS y, event_type AS text FROM events)
SELECT event_id, CASE kind WHEN 'click' THEN 'Click at (' || x || ', ' || y || ').' WHEN 'long_press' THEN 'Long press at (' || x || ', ' || y || ').' WHEN 'scroll' THEN 'Scroll down.' WHEN 'input_text' THEN 'Type: ' || text
 WHEN 'answer' THEN 'Answer: ' || text WHEN 'ask_user' THEN 'Ask user: ' || text WHEN 'navigate_back' THEN 'Navigate back.' WHEN 'navigate_home' THEN 'Navigate to home screen.' WHEN 'keyboard_enter' THEN 'Press enter.' WHEN 'wait' THEN 'Wait for screen to update.' END AS words FROM m""")
def fn_action_desc(spark, d):
    m = _mobile(spark, d)
    return m.select("event_id", T.mobile_description(F.col("kind"), F.col("x"), F.col("y"), F.col("text"), F.lit("down")).alias("words"))


CALLS = """concat('<think>t', l_linenumber, '</think>\nAction: tap\n<tool_call>\n', CASE WHEN l_linenumber = 7 THEN '{broken' ELSE concat('{"name": "mobile_use", "arguments": {"action": "', CASE WHEN l_linenumber = 6 THEN 'terminate' ELSE 'click' END, '"', CASE WHEN l_linenumber = 5 THEN '' ELSE concat(', "coordinate": [', cast(px as int), ', ', cast(floor(py) as int), ']') END, '}}') END, '\n</tool_call>')"""


def calls(spark, d):
    return X.boxes(spark, d).withColumn("response", F.expr(CALLS))


@query(f"WITH {X.BOXES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'terminate' ELSE 'click' END AS action, CASE WHEN l_linenumber IN (5, 7) THEN 0 ELSE px END::DOUBLE AS x, CASE WHEN l_linenumber IN (5, 7) THEN 0 ELSE floor(py) END::DOUBLE AS y, l_linenumber = 6 AS refusal, 2 AS thought FROM boxes")
def fn_tool_call(spark, d):
    c = calls(spark, d).withColumn("c", T.tool_call(F.col("response")))
    at = T.coordinate_or_origin(F.col("c"))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", F.col("c.arguments.action").alias("action"), at[0].alias("x"), at[1].alias("y"), T.is_refusal(F.col("c")).alias("refusal"), T.thought_length(F.col("response")).alias("thought"))


PREDICTIONS = r"""CASE o_orderkey % 4 WHEN 0 THEN concat('Thought:  ', o_orderpriority, ' \nAction: {"id": ', o_custkey, '} ') WHEN 1 THEN concat('no thought {"a": ', o_custkey, '} tail')
 WHEN 2 THEN concat('## Action:\nTap ', o_custkey, '.\n## Next\nx') ELSE concat('Action: press ', o_custkey, '<tool_call>{}</tool_call>') END"""


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS thought, CASE o_orderkey % 4 WHEN 0 THEN '{"id": ' || o_custkey || '}' WHEN 1 THEN '{"a": ' || o_custkey || '}' WHEN 2 THEN '' ELSE '{}' END AS raw,
 CASE o_orderkey % 4 WHEN 0 THEN '{"id": ' || o_custkey || '}' WHEN 1 THEN '' WHEN 2 THEN 'Tap ' || o_custkey || '.' ELSE 'press ' || o_custkey END AS description FROM orders""")
def fn_prediction(spark, d):
    o = X.read(spark, d, "orders").select("o_orderkey", F.expr(PREDICTIONS).alias("t")).withColumn("p", T.prediction(F.col("t")))
    return o.select("o_orderkey", F.col("p.thought").alias("thought"), F.col("p.raw").alias("raw"), T.action_description(F.col("t")).alias("description"))


BOXED = r"""CASE l_linenumber % 4 WHEN 0 THEN concat('{"bbox": [', l_partkey % 1000, ', ', l_suppkey % 1000, ', 3, 1000]}') WHEN 1 THEN concat('box ', l_partkey % 1000, ' ', l_suppkey % 1000, ' 40 50 60')
 WHEN 2 THEN concat('-', l_partkey % 1000 + 1, ' ', l_suppkey % 1000, ' 3 4') ELSE concat(l_partkey, ' ', l_suppkey, ' 3') END"""


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_partkey % 1000 || ',' || l_suppkey % 1000 || ',3,1000' WHEN 1 THEN l_partkey % 1000 || ',' || l_suppkey % 1000 || ',40,50' WHEN 2 THEN '-' || (l_partkey % 1000 + 1) || ',' || l_suppkey % 1000 || ',3,4' END AS box,
 CASE l_linenumber % 4 WHEN 0 THEN l_partkey % 1000 || ',' || l_suppkey % 1000 || ',3,999' WHEN 1 THEN l_partkey % 1000 || ',' || l_suppkey % 1000 || ',40,50' END AS clamped FROM lineitem""")
def fn_bbox_json(spark, d):
    t = X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.box_numbers(F.expr(BOXED)).alias("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", text(F.col("b")).alias("box"), text(T.clamped_box(F.col("b"))).alias("clamped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_partkey % 1000) || ',' || (l_suppkey % 1000) || ' ' || l_linenumber || ',' || round_even(l_quantity + 0.5, 0)::INT END AS pairs FROM lineitem")
def fn_coords_pair(spark, d):
    line = X.read(spark, d, "lineitem")
    text = F.expr("concat('from [', l_partkey % 1000, ', ', l_suppkey % 1000, '] to [ ', l_linenumber, ',', l_quantity + CASE WHEN l_linenumber = 7 THEN 1000.5 ELSE 0.5 END, ' ] or [1, 1]')")
    pairs = T.number_pairs(text)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.transform(pairs, lambda p: F.array_join(p.cast("array<string>"), ",")), " ").alias("pairs"))


@query(f"WITH {X.STEPS} SELECT episode_id, step, '<think>' || chr(10) || role || chr(10) || '</think>' || chr(10) || CASE WHEN device = 'mobile' THEN 'Thought' ELSE 'Action' END || ': ' || action || chr(10) || '<tool_call>' || chr(10) || '{{}}' || chr(10) || '</tool_call>' AS truth, action AS without FROM steps")
def fn_ground_truth_text(spark, d):
    s = X.steps(spark, d)
    make = lambda label: T.ground_truth(F.col("role"), F.col("action"), F.lit("{}"), label)
    truth = F.when(F.col("device") == "mobile", make("Thought")).otherwise(make("Action"))
    return s.select("episode_id", "step", truth.alias("truth"), T.without_thought(F.concat(F.lit("<think>x\ny</think>"), "action")).alias("without"))


@query("SELECT o_orderkey, 'Task' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '_v3_' || lower(o_orderstatus) ELSE '' END AS base, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE '' END AS suffix, 'Task' || o_custkey AS task FROM orders")
def fn_folder_parse(spark, d):
    o = X.read(spark, d, "orders")
    folder = F.expr("concat('Task', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('_v3_', lower(o_orderstatus)) ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN '_backup_20240101_7' ELSE '' END)")
    return o.select("o_orderkey", T.folder_parts(folder).alias("p")).select("o_orderkey", "p.base", "p.suffix", "p.task")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey::VARCHAR END AS strict, CASE WHEN l_linenumber = 7 THEN '7' ELSE '1,' || l_partkey END AS flexible, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM lineitem")
def fn_gsm8k_answer(spark, d):
    from tracewright.functions.scoring import gsm8k_score

    text = F.expr("CASE WHEN l_linenumber = 7 THEN 'it is 7' ELSE concat(repeat('pad ', 90), '#### 12 and #### ', l_partkey, ' so 1,', l_partkey, ' . ') END")
    line = X.read(spark, d, "lineitem").withColumn("t", text)
    score = gsm8k_score(F.col("t"), F.col("l_partkey").cast("string"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", T.gsm8k_strict(F.col("t")).alias("strict"), T.gsm8k_flexible(F.col("t")).alias("flexible"), score.alias("score"))


@query("""SELECT item_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g')), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the')), ' ') AS plain FROM benchmark""")
def fn_qa_normalize(spark, d):
    return X.read(spark, d, "benchmark").select("item_id", T.qa_normalized(F.col("text")).alias("plain"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 2 THEN '' END AS body, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n FROM documents""")
def fn_answer_tag(spark, d):
    tagged = F.expr(r"CASE doc_id % 4 WHEN 0 THEN concat('<answer>x</answer> <answer> ', source, ' </answer>') WHEN 1 THEN concat('none ', lang) WHEN 2 THEN '<answer>\n</answer>' ELSE concat('<answer>open ', lang) END")
    t = X.read(spark, d, "documents").select("doc_id", tagged.alias("t"))
    return t.select("doc_id", F.regexp_replace(T.answer_tag(F.col("t")), r"^\s+|\s+$", "").alias("body"), F.regexp_count("t", F.lit("</answer>")).alias("n"))


@query("SELECT doc_id, position('heon' IN lower(text))::INT AS first, len(regexp_extract_all(lower(text), 'heon'))::INT AS n FROM documents WHERE position('heon' IN lower(text)) > 0")
def fn_highlight(spark, d):
    docs = X.read(spark, d, "documents").withColumn("l", F.lower("text"))
    return docs.where(F.instr("l", "heon") > 0).select("doc_id", F.instr("l", "heon").alias("first"), F.regexp_count("l", F.lit("heon")).alias("n"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), ''), 'none') AS title FROM pages")
def fn_tag_text(spark, d):
    title = T.found(F.col("html"), r"(?s)<title>(.*?)</title>")
    return X.read(spark, d, "pages").select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.lit("none")).alias("title"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<image>' || text || '<video>' WHEN 1 THEN text ELSE text || '<image><image>' END AS t FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, list_filter(string_split(replace(replace(t, '<image>', chr(1) || '<image>' || chr(1)), '<video>', chr(1) || '<video>' || chr(1)), chr(1)), lambda p: p <> '') AS s FROM t)
SELECT doc_id, array_to_string(list_transform(s, lambda p: CASE p WHEN '<image>' THEN 'image' WHEN '<video>' THEN 'video' ELSE 'text' END), '|') AS kinds, array_to_string(list_filter(s, lambda p: p NOT IN ('<image>', '<video>')), '') AS body FROM s""")
def prj_mask_media(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<image>"), "text", F.lit("<video>"))).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.concat("text", F.lit("<image><image>")))
    s = X.read(spark, d, "documents").where("length(text) > 0").select("doc_id", T.media_segments(t).alias("s"))
    return s.select("doc_id", F.array_join("s.type", "|").alias("kinds"), F.array_join(F.filter("s.text", lambda v: v.isNotNull()), "").alias("body"))


@query("SELECT doc_id, doc_id % 9 IN (0, 1, 7) AS valid FROM documents")
def flt_valid_messages(spark, d):
    """Nine forms of a message: without thoughts, with one, empty, alone, left open, in the wrong order, with two, ended, nothing but the end."""
    forms = [("w", ""), ("<think>a</think> w", ""), ("<think></think>w", ""), ("<think>w", "</think>"), ("<think>a w", ""), ("</think>a<think>w", ""), ("<think>a</think><think>b</think>w", ""), ("<think>a</think>w", "<|im_end|>"), ("<|im_end|>", None)]
    k = (F.col("doc_id") % 9).cast("int") + 1
    before, after = (F.element_at(F.array(*[F.lit(f[i]) for f in forms]), k) for i in (0, 1))
    t = F.when(after.isNull(), before).otherwise(F.concat(before, F.col("doc_id").cast("string"), after))
    return X.read(spark, d, "documents").select("doc_id", T.valid_message(t).alias("valid"))


@query("SELECT doc_id, source AS reasoning, lang AS content FROM documents")
def prj_reasoning_split(spark, d):
    t = F.concat(F.lit("<think>"), "source", F.lit("</think>"), "lang")
    docs = X.read(spark, d, "documents").withColumn("t", t)
    return docs.select("doc_id", T.found(F.col("t"), r"(?s)<think>(.*?)</think>").alias("reasoning"), T.without_thought(F.col("t")).alias("content"))


MATH = r"""CASE l_linenumber % 7 WHEN 0 THEN concat('x = \\frac{', l_partkey, '}{', l_suppkey + 1, '}') WHEN 1 THEN concat('\\text{', l_partkey, ' dollars}') WHEN 2 THEN concat(1 + l_partkey % 9, ',', lpad(l_suppkey % 1000, 3, '0'), CASE WHEN l_partkey % 2 = 0 THEN '' ELSE '.0' END)
 WHEN 3 THEN concat('\\boxed{', l_partkey, '}') WHEN 4 THEN concat(l_partkey, '\\%') WHEN 5 THEN concat('$', l_partkey, '.$') ELSE concat('\\sqrt', l_partkey, ' km') END"""


@query(r"""WITH t AS (SELECT *, '\frac{' || l_partkey || '}{' || (l_suppkey + 1) || '}' AS f, (1 + l_partkey % 9) || ',' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') AS n, '\sqrt{' || substr(l_partkey::VARCHAR, 1, 1) || '}' || substr(l_partkey::VARCHAR, 2) AS r FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7 WHEN 0 THEN f WHEN 2 THEN CASE WHEN l_partkey % 2 = 0 THEN replace(n, ',', '') ELSE n || '.0' END WHEN 4 THEN l_partkey || '\%' WHEN 6 THEN r ELSE l_partkey::VARCHAR END AS final,
 CASE l_linenumber % 7 WHEN 0 THEN f WHEN 1 THEN '\text{' || l_partkey || 'dollars}' WHEN 2 THEN n || CASE WHEN l_partkey % 2 = 0 THEN '' ELSE '.0' END WHEN 3 THEN '\boxed{' || l_partkey || '}' WHEN 4 THEN l_partkey::VARCHAR WHEN 5 THEN '$' || l_partkey || '.$' ELSE r || 'km' END AS boxed FROM t""")
def fn_math_normalize(spark, d):
    """An answer in two graders' normal forms."""
    t = F.expr(MATH)
    return X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", A.final_form(t).alias("final"), A.boxed_form(t).alias("boxed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 6 IN (0, 1, 3, 5) AS same FROM lineitem")
def fn_math_equal(spark, d):
    """A fraction and its decimal, a percentage and its share, other numbers, other spacing, other names, thousands."""
    a = F.expr(r"CASE l_linenumber % 6 WHEN 0 THEN concat(l_partkey, '.5') WHEN 1 THEN concat(l_partkey, '\\%') WHEN 2 THEN string(l_partkey) WHEN 3 THEN concat('x+', l_partkey) WHEN 4 THEN concat('x', l_partkey) ELSE concat(1 + l_partkey % 9, ',', lpad(l_suppkey % 1000, 3, '0')) END")
    b = F.expr(r"CASE l_linenumber % 6 WHEN 0 THEN concat('\\frac{', 2 * l_partkey + 1, '}{2}') WHEN 1 THEN string(cast(l_partkey / 100 AS decimal(20, 2))) WHEN 2 THEN string(2 * l_partkey + 1) WHEN 3 THEN concat('x + ', l_partkey) WHEN 4 THEN concat('y', l_partkey) ELSE concat(1 + l_partkey % 9, lpad(l_suppkey % 1000, 3, '0'), '.0') END")
    t = X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", Y.right_answer(F.col("a"), F.col("b")).alias("same"))


PYTHON = r"""CASE p_partkey % 5 WHEN 0 THEN concat('so \\boxed{\\frac{1}{2}} and \\boxed{', p_partkey, '{b}c}') WHEN 1 THEN concat('```json\n{"b": ', p_partkey, ', "a": {"c": 2}}\n```') WHEN 2 THEN concat('{"b":', p_partkey, ',"a":2}')
 WHEN 3 THEN concat('\\boxed{open ', p_partkey) ELSE repeat(concat('ab', p_partkey), 40) END"""


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_partkey || '{b}c' END AS boxed, CASE p_partkey % 5 WHEN 1 THEN '{"b": ' || p_partkey || ', "a": {"c": 2}}' WHEN 2 THEN '{"b": ' || p_partkey || ', "a": 2}' END AS first_json,
 CASE WHEN p_partkey % 5 = 2 THEN '{"a": 2, "b": ' || p_partkey || '}' END AS canonical, p_partkey % 5 = 4 AS repetitive FROM part""")
def fn_python_text(spark, d):
    """Balanced braces, fenced JSON, sorted keys and repetitiveness: the text functions that run as pandas UDFs."""
    # Dealt to tasks by key: a file's bytes don't tell how much work its texts are.
    t = X.read(spark, d, "part").select("p_partkey", F.expr(PYTHON).alias("t")).repartition("p_partkey")
    return t.select("p_partkey", T.boxed("t").alias("boxed"), T.first_json("t").alias("first_json"), T.canonical_json("t").alias("canonical"), T.is_repetitive("t").alias("repetitive"))


# ---- geometry ----


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity * 999 / 1920.0, 0)::INT AS gx, round_even(l_extendedprice * 999 / 100000.0, 0)::INT AS gy, greatest(0, least(1000, round_even(l_extendedprice * 1000 / 50000.0, 0)))::INT AS clamped, round(l_quantity / 1000 * 1920, 6) AS px FROM lineitem")
def fn_permille_normalize(spark, d):
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.on_grid(q, F.lit(1920.0)).alias("gx"), G.on_grid(e, F.lit(100000.0)).alias("gy"), G.clamped_on_grid(e, F.lit(50000.0)).alias("clamped"), F.round(G.off_grid(q, F.lit(1920.0)), 6).alias("px"))


@query(f"WITH {X.BOXES} SELECT l_orderkey, l_linenumber, l_partkey, floor((x1 + x2) / 2)::BIGINT AS cx, floor((y1 + y2) / 2)::BIGINT AS cy, px + x1 AS right, py + y1 AS bottom FROM boxes")
def fn_bbox_center_xyxy(spark, d):
    b = X.boxes(spark, d)
    c = G.box_center(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    r = G.xywh_to_xyxy(*[F.col(c) for c in ("px", "py", "x1", "y1")])
    return b.select("l_orderkey", "l_linenumber", "l_partkey", c[0].cast("long").alias("cx"), c[1].cast("long").alias("cy"), r[2].alias("right"), r[3].alias("bottom"))


@query("""WITH s AS (SELECT p_partkey, 100 + p_size * 37 AS h, 50 + (p_partkey % 90) * 20 AS w FROM part),
f AS (SELECT *, CASE WHEN h * w < 200704 THEN sqrt(200704.0 / (h * w)) WHEN h * w > 1003520 THEN sqrt(1003520.0 / (h * w)) ELSE 1.0 END::DOUBLE AS k FROM s)
SELECT p_partkey, greatest(28, round_even(h * k / 28, 0) * 28)::INT AS height, greatest(28, round_even(w * k / 28, 0) * 28)::INT AS width FROM f""")
def fn_smart_resize(spark, d):
    s = X.read(spark, d, "part").select("p_partkey", (F.lit(100) + F.col("p_size") * 37).cast("double").alias("h"), (F.lit(50) + (F.col("p_partkey") % 90) * 20).cast("double").alias("w"))
    return s.select("p_partkey", G.smart_resize(F.col("h"), F.col("w"), 200704, 1003520).alias("r")).select("p_partkey", "r.height", "r.width")


@query("SELECT event_id, ['500,750,500,250', '500,250,500,750', '250,500,750,500', '750,500,250,500', NULL][(event_id % 5)::INT + 1] AS swipe FROM events")
def fn_scroll_fallback(spark, d):
    direction = F.expr("element_at(array('down', 'up', 'left', 'right', 'away'), cast(event_id % 5 as int) + 1)")
    return X.read(spark, d, "events").select("event_id", F.array_join(G.swipe_for_scroll(direction).cast("array<string>"), ",").alias("swipe"))


@query("SELECT event_id, (event_id % 3 = 0) AS line, least(-((event_id % 97) - 64) / 32.0, 0)::DOUBLE AS penalty, (event_id % 97) * 24576 + (event_id % 97) * (event_id % 97) AS work FROM events")
def fn_collinear_overlong_workload(spark, d):
    e = X.read(spark, d, "events")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k = F.col("event_id") % 50
    points = F.array(at(k, F.lit(1)), at(k + 2, F.lit(3)), at(k + 4, F.when(F.col("event_id") % 3 == 0, 5).otherwise(6)), at(k + 1, F.lit(100)))
    n = F.col("event_id") % 97
    return e.select("event_id", G.any_collinear(points).alias("line"), G.overlong_penalty(n, 96, 32).alias("penalty"), G.workload(n).alias("work"))
