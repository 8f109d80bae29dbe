"""Scores of structured answers as column expressions over parsed calls (struct(name, arguments))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import answers as A
from tracewright.functions import text as X
from tracewright.functions.geometry import any_collinear, point_in_box
from tracewright.functions.once import bound

# Which parts count for each action of each tool (fixed values of the scoring rules).
PARTS = {
    "mobile_use": {
        "click": ("place",), "long_press": ("place",), "swipe": ("place", "end"), "type": ("text",), "answer": ("text",),
        "system_button": ("button",), "wait": (), "terminate": ("status",),
    },
    "computer_use": {
        "left_click": ("place",), "right_click": ("place",), "middle_click": ("place",), "double_click": ("place",), "triple_click": ("place",), "mouse_move": ("place",),
        "left_click_drag": ("place",), "type": ("text",), "key": ("keys",), "scroll": ("place", "turn"), "hscroll": ("place", "turn"), "wait": (), "terminate": ("status",),
    },
}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _place(p: Column, label: Column, box: Column) -> Column:
    """In the box if there is one, else equal to the label's point; box is array(x1, y1, x2, y2) or null."""
    inside = point_in_box(p[0], p[1], box[0], box[1], box[2], box[3]) & (F.size(p) == 2)
    return _sure(F.when(F.size(box) > 0, inside).otherwise(p == label))


def parts(predict: Column, label: Column, box: Column, box2: Column) -> dict[str, Column]:
    p, q = predict["arguments"], label["arguments"]
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keys = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)))
    sign = lambda c: F.signum(F.coalesce(c, F.lit(0.0)))
    return {
        "action": _sure(p["action"] == q["action"]),
        "place": _place(p["coordinate"], q["coordinate"], box),
        "end": _place(p["coordinate2"], q["coordinate2"], box2),
        "text": plain(p["text"]) == plain(q["text"]),
        "button": p["button"].eqNullSafe(q["button"]),
        "status": p["status"].eqNullSafe(q["status"]),
        "keys": keys(p["keys"]) == keys(q["keys"]),
        "turn": sign(p["pixels"]) == sign(q["pixels"]),
    }


#: The parts in order, and for each tool and action the places of those that count (from 1; the action always does).
HELD = ("action", "place", "end", "text", "button", "status", "keys", "turn")


def counted_parts(label: Column) -> Column:
    pairs = [(f"{tool} {action}", F.array(*[F.lit(1 + HELD.index(n)) for n in ("action", *names)])) for tool, actions in PARTS.items() for action, names in actions.items()]
    return F.create_map(*[x for name, places in pairs for x in (F.lit(name), places)])[F.concat_ws(" ", label["name"], label["arguments"]["action"])]


def part_share(predict: Column, label: Column, box: Column, box2: Column) -> Column:
    """The share of counted parts that hold, by the label's tool and action; null for actions without a rule."""

    def share(p: Column, q: Column) -> Column:
        each = parts(p, q, box, box2)
        held = F.array(*[F.when(each[n], 1.0).otherwise(0.0) for n in HELD])
        return bound(held, lambda h: bound(counted_parts(q), lambda c: F.aggregate(c, F.lit(0.0), lambda a, i: a + h[i - 1]) / F.size(c)))

    return bound(predict, lambda p: bound(label, lambda q: share(p, q)))


def _share(p: Column, q: Column, box: Column, box2: Column) -> Column:
    return F.when(p.isNotNull() & q.isNotNull(), part_share(p, q, box, box2))


def _score(share: Column) -> Column:
    return bound(share, lambda s: F.when(s.isNull(), -1.0).when(s == 1, 1.0).otherwise(-0.5))


def gui_score(response: Column, truth: Column, box: Column, box2: Column) -> Column:
    """1 if all parts hold, -0.5 if not, -1 if an answer can't be read or the action has no rule. Each text is parsed once."""
    return bound(X.tool_call(response), lambda p: bound(X.tool_call(truth), lambda q: _score(_share(p, q, box, box2))))


def call_score(p: Column, q: Column, box: Column, box2: Column) -> Column:
    """``gui_score`` of parsed calls, which should be columns of their own: without lambdas, so that it is compiled and a constant label's parts go."""
    each, counted = parts(p, q, box, box2), counted_parts(q)
    held = F.lit(True)
    for i, n in enumerate(HELD):
        held &= ~F.array_contains(counted, 1 + i) | _sure(each[n])
    return F.when(p.isNull() | q.isNull() | counted.isNull(), -1.0).when(held, 1.0).otherwise(-0.5)


def gui_score_with_other(response: Column, truth: Column, box: Column, box2: Column, other: Column, other_box: Column, other_box2: Column) -> Column:
    """The second label can only lift a score to 1; its boxes stand in where it has them. The response is parsed once for both."""

    def score(p: Column) -> Column:
        second = bound(X.tool_call(other), lambda q: _score(_share(p, q, F.coalesce(other_box, box), F.coalesce(other_box2, box2))))
        first = bound(X.tool_call(truth), lambda q: _score(_share(p, q, box, box2)))
        return bound(first, lambda f: F.when((f != 1) & other.isNotNull(), F.when(second == 1, 1.0).otherwise(f)).otherwise(f))

    return bound(X.tool_call(response), score)


def compute_score(response: Column, truth: Column, box: Column, box2: Column) -> Column:
    """struct(score, acc, thought_length, share): of one parse of both texts; share is that of the parts that hold, null where there is none."""
    made = lambda share, s: F.struct(s.alias("score"), F.when(s == 1, 1.0).otherwise(0.0).alias("acc"), X.thought_length(response).alias("thought_length"), share.alias("share"))
    judged = lambda p, q: bound(_share(p, q, box, box2), lambda share: bound(_score(share), lambda s: made(share, s)))
    return bound(X.tool_call(response), lambda p: bound(X.tool_call(truth), lambda q: judged(p, q)))


def gsm8k_score(text: Column, truth: Column, strict: bool = True, wrong: float = 0.0) -> Column:
    answer = X.gsm8k_strict(text) if strict else X.gsm8k_flexible(text)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(wrong)


def qa_score(text: Column, golden: Column, contained: bool = False, wrong: float = 0.0) -> Column:
    """Normalised equality with a golden answer (or containing it); over ten answer tags a right answer counts a quarter."""
    answer = X.qa_normalized(X.answer_tag(text))
    hit = F.exists(golden, lambda g: F.contains(answer, X.qa_normalized(g)) if contained else answer == X.qa_normalized(g))
    full = F.when(F.regexp_count(text, F.lit("</answer>")) > 10, 0.25).otherwise(1.0)
    return F.when(answer.isNull(), 0.0).when(hit, full).otherwise(wrong)


def minerva_answer(text: Column) -> Column:
    """What follows the last ``Answer:`` in the last 300 characters, in final form; [INVALID] without one."""
    hits = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.when(F.size(hits) > 0, A.final_form(F.element_at(hits, -1))).otherwise("[INVALID]")


def math_dapo_score(text: Column, truth: Column) -> Column:
    return F.when(minerva_answer(text) == A.final_form(truth), 1.0).otherwise(-1.0)


def step_error_score(predicted: Column, truth: Column, total: Column) -> Column:
    """Nearness of a judged error step to the true one; -1 means none, null an unreadable judgement."""
    both = F.when(predicted == -1, 1.0).otherwise(-1.0)
    near = F.when(predicted == -1, -1.0).otherwise(1 - F.abs(predicted - truth) / total)
    return F.when(predicted.isNull(), -1.0).when(truth == -1, both).otherwise(near)


def ranked_point_score(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 / sqrt(n k) for the first of n points, the k-th, in the box; -1/n if none is; -1 for no points or three in a line."""

    def score(points: Column) -> Column:
        n = F.size(points)
        hits = F.transform(points, lambda p: F.when(point_in_box(p["x"], p["y"], x1, y1, x2, y2), 1).otherwise(0))
        bad = F.coalesce(points.isNull() | (n == 0) | any_collinear(points), F.lit(True))
        return bound(F.array_position(hits, 1), lambda k: F.when(bad, -1.0).when(k > 0, 1 / F.sqrt(n * k)).otherwise(-1 / n))

    return bound(points, score)


def on_last_token(score: Column, length: Column) -> Column:
    """Token rewards: the score at the last valid token, 0 before."""
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == length, score).otherwise(0.0))


# Which scorer a data source gets, by whole name or by a part of it (fixed values of the dispatch).
GUI_SOURCES, GUI_PARTS = ("mobile", "desktop", "badcase"), ("ui_", "guiagent")


def dispatched(source: Column, scorers: dict[str, Column], gui: Column) -> Column:
    """The score by data source; an unknown source is an error."""
    mine = source.isin(*GUI_SOURCES)
    for part in GUI_PARTS:
        mine |= F.contains(source, F.lit(part))
    out = F.when(mine, gui)
    for name, score in scorers.items():
        out = out.when(source == name, score)
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))
