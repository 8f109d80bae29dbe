"""Parsing of model output and recorded actions as column expressions; Python only where regular expressions can't reach."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tracewright.functions.once import bound

TOOL_CALL = r"(?s)<tool_call>(.*?)</tool_call>"

# First words of recorded desktop action lines (fixed values of the recording format).
LINE_STARTS = (
    "pyautogui.click(", "pyautogui.doubleClick(", "pyautogui.rightClick(", "pyautogui.tripleClick(", "pyautogui.middleClick(", "pyautogui.moveTo(",
    "pyautogui.scroll(", "pyautogui.hscroll(", "pyautogui.typewrite(", "pyautogui.write(", "pyautogui.sleep(", "pyautogui.hotkey(", "pyautogui.press(",
    "pyautogui.keyDown(", "pyautogui.keyUp(", "pyautogui.dragTo(", "pyautogui.drag(", "pyautogui.mouseDown(", "pyautogui.mouseUp(", "time.sleep(",
)
# Function name to tool action (fixed values of the tool's schema).
POINTER = {"click": "left_click", "doubleClick": "double_click", "rightClick": "right_click", "tripleClick": "triple_click", "middleClick": "middle_click", "moveTo": "mouse_move"}
DRAGS = ("dragTo", "drag", "mouseDown", "mouseUp")
# Mobile action types and what they become (fixed values of the tool's schema).
MOBILE_TYPES = ("click", "long_press", "input_text", "scroll", "drag", "navigate_back", "navigate_home", "keyboard_enter", "wait", "status", "answer", "ask_user")
MOBILE_ACTIONS = {"click": "click", "long_press": "long_press", "input_text": "type", "answer": "answer", "wait": "wait", "ask_user": "ask_user", "status": "terminate", "drag": "swipe", "scroll": "swipe", "navigate_back": "system_button", "navigate_home": "system_button", "keyboard_enter": "system_button"}
BUTTONS = {"navigate_back": "Back", "navigate_home": "Home", "keyboard_enter": "Enter"}

ARGUMENTS = "action string, coordinate array<double>, coordinate2 array<double>, start_coordinate array<double>, pixels double, text string, keys array<string>, time double, button string, status string"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null without a match (an empty group stays empty)."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def mapped(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def tool_call(text: Column) -> Column:
    """struct(name, arguments) of the first tool call; null if there is none, it isn't JSON, or it has no action."""
    parsed = F.from_json(found(text, TOOL_CALL), f"name string, arguments struct<{ARGUMENTS.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double')}>")
    return bound(parsed, lambda c: F.when(c["arguments"]["action"].isNotNull(), c))


def coordinate_or_origin(call: Column) -> Column:
    return F.coalesce(call["arguments"]["coordinate"], F.array(F.lit(0.0), F.lit(0.0)))


def is_refusal(call: Column) -> Column:
    return F.coalesce(call["arguments"]["action"] == "terminate", F.lit(False))


def prediction(text: Column) -> Column:
    """struct(thought, raw) of ``Thought: ... Action: {...}``; without a closing action any braces count."""
    thought = stripped(F.coalesce(found(text, r"(?s)Thought:\s*(.*?)\s*Action:"), F.lit("")))
    raw = F.coalesce(found(text, r"(?s)Action:\s*(\{.*\})\s*$"), found(text, r"(?s)(\{.*\})"), F.lit(""))
    return F.struct(thought.alias("thought"), stripped(raw).alias("raw"))


def action_description(text: Column) -> Column:
    """The section under ``## Action:``, else what follows ``Action:`` up to a blank line or a tool call."""
    section = found(text, r"(?s)##\s*Action:\s*(.*?)(?:\n##|\z)")
    return stripped(F.coalesce(section, found(text, r"(?s)Action:\s*(.*?)(?:\n\s*\n|<tool_call>|\z)"), F.lit("")))


def thought_length(text: Column) -> Column:
    """Characters of the think block, or of all before a lone closing tag; 0 without either."""
    inner = F.coalesce(found(text, r"(?s)<think(?:ing)?>(.*?)</think(?:ing)?>"), found(text, r"(?s)\A(.*?)</think(?:ing)?>"), F.lit(""))
    return F.length(stripped(inner))


def without_thought(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def ground_truth(thought: Column, action: Column, call: Column, action_label: str = "Action") -> Column:
    return F.concat(F.lit("<think>\n"), thought, F.lit(f"\n</think>\n{action_label}: "), action, F.lit("\n<tool_call>\n"), call, F.lit("\n</tool_call>"))


def known_line(line: Column) -> Column:
    text = F.trim(line)
    ok = (text == "") | text.startswith("#")
    for start in LINE_STARTS:
        ok |= text.startswith(start)
    return ok


def unknown_lines(action: Column, most: int = 3) -> Column:
    """The first lines outside the action space; none for the closing words."""
    lines = F.filter(F.split(action, "\n"), lambda x: ~known_line(x))
    return F.when(F.trim(action).isin("DONE", "FAIL", "WAIT"), F.array().cast("array<string>")).otherwise(F.slice(F.transform(lines, F.trim), 1, most))


def call_point(line: Column) -> Column:
    """array(x, y) of a call's first two arguments if both are whole numbers; else null."""
    found_ = F.regexp_extract(line, r"\(\s*([+-]?\d+\s*,\s*[+-]?\d+)\s*[,)]", 1)
    return bound(F.split(found_, r"\s*,\s*"), lambda p: F.when(F.size(p) == 2, F.array(p[0].cast("double"), p[1].cast("double"))))


def quoted(line: Column, function: str) -> Column:
    """A call's text argument: triple quotes before single ones, a named message before a plain argument."""
    quotes = ('"""', "'''", '"', "'")
    named = [rf"(?s)message\s*=\s*{q}(.*?){q}" for q in ("'''", '"""', "'", '"')] if function == "write" else []
    plain = [rf"(?s)pyautogui\.{function}\(\s*{q}(.*?){q}" for q in quotes]
    return F.coalesce(*[found(line, p) for p in named + plain], F.lit(""))


def _args(**columns: Column) -> Column:
    kinds = [x.rsplit(" ", 1) for x in ARGUMENTS.split(", ")]
    return F.struct(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds])


def _scaled(point: Column, width: int, height: int, grid: int) -> Column:
    return bound(point, lambda p: F.when(p.isNotNull(), F.array(F.bround(p[0] * grid / width, 0), F.bround(p[1] * grid / height, 0))))


def line_plan(line: Column, width: int = 1920, height: int = 1080, grid: int = 999) -> Column:
    """Tool arguments of one recorded line; an unknown line is a left click without a place."""

    def plan(line: Column, name: Column) -> Column:
        point = lambda: _scaled(call_point(line), width, height, grid)
        inner = F.regexp_extract(line, r"\((.+)\)", 1)
        amount = F.regexp_extract(line, r"\(\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
        scroll_at = _scaled(call_point(F.regexp_replace(line, r"\(\s*[+-]?[\d.]+\s*,", "(")), width, height, grid)
        keys = F.transform(F.split(inner, ","), lambda k: F.regexp_replace(F.trim(k), r"^['\"]+|['\"]+$", ""))
        seconds = F.coalesce(F.regexp_extract(line, r"sleep\(\s*([\d.]+)\s*\)", 1).try_cast("double"), F.lit(0.5))
        return (
            F.when(name.isin(*POINTER), _args(action=mapped(name, POINTER), coordinate=point()))
            .when(name.isin("scroll", "hscroll"), _args(action=name, pixels=bound(amount, lambda n: F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))), coordinate=scroll_at))
            .when(name == "typewrite", _args(action=F.lit("type"), text=quoted(line, "typewrite")))
            .when(name == "write", _args(action=F.lit("type"), text=quoted(line, "write")))
            .when(name == "sleep", _args(action=F.lit("wait"), time=seconds))
            .when((name == "hotkey") & (inner != ""), _args(action=F.lit("key"), keys=keys))
            .when((name == "press") & F.regexp_like(line, F.lit(r"['\"].+?['\"]")), _args(action=F.lit("key"), keys=F.array(F.regexp_extract(line, r"['\"](.+?)['\"]", 1))))
            .when(name.isin(*DRAGS), _args(action=F.lit("left_click_drag"), coordinate=point()))
            .otherwise(_args(action=F.lit("left_click")))
        )

    return bound(line, lambda x: bound(F.regexp_extract(x, r"^(?:pyautogui|time)\.(\w+)\(", 1), lambda name: plan(x, name)))


def action_plan(action: Column, width: int = 1920, height: int = 1080, grid: int = 999, result_score: float = 1.0) -> Column:
    """Tool arguments of a recorded action of one or more lines, or of a closing word."""
    starts = lambda c, s: F.coalesce(c.startswith(f"pyautogui.{s}("), F.lit(False))
    at = lambda c: _scaled(call_point(c), width, height, grid)
    closing = {"DONE": "success" if result_score >= 1 else "failure", "FAIL": "failure"}

    def several(lines: Column) -> Column:
        n, first, second, third = F.size(lines), lines[0], F.try_element_at(lines, F.lit(2)), F.try_element_at(lines, F.lit(3))
        downs = F.transform(F.filter(lines, lambda x: starts(x, "keyDown")), lambda x: F.regexp_extract(x, r"keyDown\(\s*['\"](.+?)['\"]\s*\)", 1))
        chord = F.forall(lines, lambda x: starts(x, "keyDown") | starts(x, "keyUp")) & F.exists(lines, lambda x: starts(x, "keyDown"))
        moved = F.filter(lines, lambda x: x.startswith("pyautogui.") & ~x.startswith("pyautogui.sleep("))
        scrolled = F.regexp_extract(second, r"\(\s*([+-]?\d+)", 1).try_cast("double")
        # One line, or the first that moves something; null where neither is.
        single = bound(F.when(n == 1, first).otherwise(F.try_element_at(moved, F.lit(1))), lambda x: F.when(x.isNotNull(), line_plan(x, width, height, grid)))
        return (
            F.when(n == 1, single)
            .when((n == 2) & starts(first, "moveTo") & starts(second, "scroll"), _args(action=F.lit("scroll"), pixels=scrolled, coordinate=at(first)))
            .when((n == 2) & starts(first, "moveTo") & starts(second, "dragTo"), _args(action=F.lit("left_click_drag"), coordinate=at(second), start_coordinate=at(first)))
            .when((n >= 3) & starts(first, "click") & starts(second, "typewrite") & starts(third, "keyDown"), _args(action=F.lit("type"), text=quoted(second, "typewrite")))
            .when((n == 3) & starts(first, "typewrite") & starts(second, "keyDown") & starts(third, "keyUp"), _args(action=F.lit("type"), text=quoted(first, "typewrite")))
            .when(chord, _args(action=F.lit("key"), keys=downs))
            .otherwise(F.coalesce(single, _args(action=F.lit("wait"), time=F.lit(1))))
        )

    def plan(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
        return (
            F.when(text.isin(*closing), _args(action=F.lit("terminate"), status=mapped(text, closing)))
            .when(text == "WAIT", _args(action=F.lit("wait"), time=F.lit(5)))
            .otherwise(bound(lines, several))
        )

    return bound(F.trim(action), plan)


def mobile_plan(kind: Column, x: Column, y: Column, text: Column, status: Column) -> Column:
    """Tool arguments of a mobile action; null for an unknown type."""
    point = F.when(kind.isin("click", "long_press"), F.array(x, y))
    words = F.when(kind.isin("input_text", "answer", "ask_user"), F.coalesce(text, F.lit("")))
    ended = F.when(kind == "status", F.when(status == "complete", "success").otherwise("failure"))
    waits = F.when(kind.isin("long_press", "wait"), 1.0)
    return F.when(kind.isin(*MOBILE_TYPES), _args(action=mapped(kind, MOBILE_ACTIONS), coordinate=point, text=words, status=ended, time=waits, button=mapped(kind, BUTTONS)))


def mobile_description(kind: Column, x: Column, y: Column, text: Column, direction: Column) -> Column:
    short = F.substring(F.coalesce(text, F.lit("")), 1, 50)
    place = F.concat(F.lit(" at ("), x.cast("int").cast("string"), F.lit(", "), y.cast("int").cast("string"), F.lit(")."))
    fixed = {"navigate_back": "Navigate back.", "navigate_home": "Navigate to home screen.", "keyboard_enter": "Press enter.", "wait": "Wait for screen to update."}
    return (
        F.when((kind == "click") & x.isNotNull(), F.concat(F.lit("Click"), place))
        .when((kind == "long_press") & x.isNotNull(), F.concat(F.lit("Long press"), place))
        .when(kind == "scroll", F.concat(F.lit("Scroll "), F.coalesce(direction, F.lit("")), F.lit(".")))
        .when(kind == "input_text", F.concat(F.lit("Type: "), short))
        .when(kind == "answer", F.concat(F.lit("Answer: "), short))
        .when(kind == "ask_user", F.concat(F.lit("Ask user: "), short))
        .when(kind.isin(*fixed), mapped(kind, fixed))
    )


def box_numbers(text: Column) -> Column:
    """Four whole numbers of a box: of a JSON field bbox, else the first four in the text; null if there are fewer."""
    listed = F.from_json(F.get_json_object(text, "$.bbox"), "array<double>")
    loose = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"-?\d+"), 0), 1, 4), lambda v: v.try_cast("double"))
    picked = F.when(F.size(listed) == 4, listed).when(F.size(loose) == 4, loose)
    return F.transform(picked, lambda v: F.bround(v, 0).cast("int"))


def clamped_box(box: Column, low: int = 0, high: int = 1000, top: int = 999) -> Column:
    """Null if a number is outside low..high; else clamped to top."""
    return F.when(F.forall(box, lambda v: v.between(low, high)), F.transform(box, lambda v: F.least(v, F.lit(top))))


def number_pairs(text: Column, n: int = 2) -> Column:
    """The first n pairs ``[x, y]`` within 0..1000, rounded; null if there are fewer or one is outside."""
    pattern = r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]"
    xs, ys = (F.transform(F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), 1, n), lambda v: v.try_cast("double")) for g in (1, 2))
    pairs = F.zip_with(xs, ys, lambda x, y: F.array(F.bround(x, 0).cast("int"), F.bround(y, 0).cast("int")))
    sound = (F.size(xs) == n) & F.forall(F.concat(xs, ys), lambda v: v.between(0, 1000))
    return F.when(sound, pairs)


def folder_parts(folder: Column) -> Column:
    """struct(base, suffix, task) of a run's folder name: without its backup stamp, after its version, before it."""
    base = F.regexp_replace(folder, r"_backup_\d+_\d+$", "")
    return F.struct(base.alias("base"), F.coalesce(found(base, r"_v\d+_(.*)$"), F.lit("")).alias("suffix"), F.coalesce(found(base, r"^(.*?)_v\d+"), base).alias("task"))


#: An answer's mark, one space, the answer (a fixed value of the benchmark).
GSM8K_ANSWER = r"#### (\-?[0-9\.\,]+)"


def gsm8k_strict(text: Column) -> Column:
    """The last ``#### n`` of the last 300 characters, without commas and dollars; null if there is none."""
    hits = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(GSM8K_ANSWER), F.lit(1))
    return F.regexp_replace(F.when(F.size(hits) > 0, F.element_at(hits, -1)), r"[,$]", "")


def gsm8k_flexible(text: Column) -> Column:
    """The last thing like a number in the last 300 characters that is more than a point; the first if all are points; else null."""
    hits = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"\-?[0-9\.\,]+"), F.lit(0))
    return bound(hits, lambda h: F.coalesce(F.try_element_at(F.filter(h, lambda v: v != "."), F.lit(-1)), F.try_element_at(h, F.lit(1))))


def qa_normalized(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def answer_tag(text: Column) -> Column:
    """The last answer tag's body; null without one."""
    hits = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return stripped(F.when(F.size(hits) > 0, F.element_at(hits, -1)))


def media_segments(text: Column) -> Column:
    """array(struct(type, text)): the text split at media marks, which become segments of their own; empty ones go."""
    parts = F.filter(F.split(text, r"(?<=<image>)|(?=<image>)|(?<=<video>)|(?=<video>)"), lambda p: p != "")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def valid_message(text: Column) -> Column:
    """At most one think pair, in order, with text inside and outside it; a trailing end mark doesn't count."""
    body = F.regexp_replace(text, r"(?:<\|im_end\|>)+\s*$", "")
    opens, closes = F.regexp_count(body, F.lit("<think>")), F.regexp_count(body, F.lit("</think>"))
    inside = F.trim(F.regexp_extract(body, r"(?s)<think>(.*?)</think>", 1))
    paired = (opens == 1) & (closes == 1) & F.regexp_like(body, F.lit(r"(?s)<think>.*</think>")) & (inside != "")
    return (((opens == 0) & (closes == 0)) | paired) & (F.trim(without_thought(body)) != "")


# ---- beyond regular expressions: balanced braces, suffix arrays, JSON in Python's form ----


# Text with two levels of braces in it, up to the brace that closes all; possessive, so that no text is tried twice.
_FLAT = r"[^{}]*+"
_NESTED = rf"{_FLAT}(?:\{{{_FLAT}(?:\{{{_FLAT}\}}{_FLAT})*+\}}{_FLAT})*+"
CLOSED = rf"(?s)\A({_NESTED})\}}"


def closed(rest: Column) -> Column:
    """What comes before the brace that closes one opened before the text; null if none does."""

    def deep(text: Column) -> Column:
        # More levels: the pieces that end in a brace are counted through.
        pieces = F.regexp_extract_all(text, F.lit(r"[^{}]*+[{}]"), F.lit(0))
        step = lambda a, p: F.when(a["depth"] == 0, a).otherwise(F.struct((a["depth"] + F.when(F.endswith(p, F.lit("{")), 1).otherwise(-1)).alias("depth"), (a["n"] + F.length(p)).alias("n")))
        return F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step, lambda a: F.when(a["depth"] == 0, F.substr(text, F.lit(1), a["n"] - 1)))

    return bound(rest, lambda r: F.when(F.regexp_like(r, F.lit(CLOSED)), F.regexp_extract(r, CLOSED, 1)).otherwise(deep(r)))


def boxed(text) -> Column:
    r"""The last ``\boxed{...}`` with balanced braces."""
    text = F.col(text) if isinstance(text, str) else text
    return bound(text, lambda t: F.when(F.contains(t, F.lit("\\boxed{")), closed(F.substring_index(t, "\\boxed{", -1))))


def _candidates(text: str, at: int, end: int) -> tuple[list[int], int]:
    """In a start of JSON, text[at:end]: where objects begin that close there, and braces in strings; and where to look on."""
    open_, found, quote, k = [], [], -1, at
    while k < end:
        c = text[k]
        if quote >= 0:
            if c == "\\":
                k += 1
            elif c == '"':
                quote = -1
            elif c == "{":
                found.append(k)
        elif c == '"':
            quote = k
        elif c == "{":
            open_.append(k)
        elif c == "}" and open_:
            found.append(open_.pop())
        k += 1
    return sorted(found), quote if quote >= 0 else end


def _first_json(text: str | None) -> str | None:
    """Reading stops at an error; what is still open there isn't JSON, so only what closed before it, or lies in a string, is tried."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except json.JSONDecodeError as e:
            inner, on = _candidates(text, at, e.pos)
        except RecursionError:
            inner, on = [], at + 1
        for k in inner:
            try:
                return json.dumps(decoder.raw_decode(text, k)[0], ensure_ascii=False)
            except (json.JSONDecodeError, RecursionError):
                continue
        at = text.find("{", max(on, at + 1))
    return None


@F.pandas_udf(StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object of a text, with or without a code fence, in compact form; null if there is none."""
    return texts.map(_first_json)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The JSON text with sorted keys; null if it isn't JSON."""

    def form(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(form)


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and each suffix's rank: ranks of 1, 2, 4, ... characters, each pair sorted by its halves."""
    rank, n, k = np.unique(codes, return_inverse=True)[1].astype(np.int64), len(codes), 1
    while True:
        half = np.full(n, -1, np.int64)
        half[: n - k] = rank[k:]
        key = rank * (n + 1) + half + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order, rank


def repeatness(text: str) -> float:
    """What neighbouring suffixes in order share, of the n(n+1)/2 characters of all suffixes."""
    n = len(text)
    if n <= 1:
        return 0.0
    order, rank = suffix_order(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    order, rank, shared, k = order.tolist(), rank.tolist(), 0, 0
    for i in range(n):  # from one suffix to the next shorter one, at most one shared character is lost
        if rank[i] == n - 1:
            k = 0
            continue
        j = order[rank[i] + 1]
        most = n - max(i, j)
        while k < most and text[i + k] == text[j + k]:
            k += 1
        shared += k
        k = max(0, k - 1)
    return shared * 2 / (n * (n + 1))


@F.pandas_udf(BooleanType())
def is_repetitive(texts: pd.Series) -> pd.Series:
    """Whether neighbouring suffixes share over a fifth; of whole texts, in time that grows with n log² n."""
    return texts.map(lambda t: repeatness(t or "") > 0.2)
