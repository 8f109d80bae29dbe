"""Points, boxes, grids and lengths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.once import bound


def on_grid(v: Column, size: Column, grid: int = 999) -> Column:
    """A pixel on a grid of 0..grid, rounded half to even."""
    return F.bround(v * grid / size, 0).cast("int")


def clamped_on_grid(v: Column, size: Column, grid: int = 1000) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(grid), on_grid(v, size, grid)))


def off_grid(v: Column, size: Column, grid: int = 1000) -> Column:
    return v / grid * size


def point_in_box(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners in any order, edges included; false where anything is missing."""
    inside = x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    every = x.isNotNull() & y.isNotNull() & x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.coalesce(every & inside, F.lit(False))


def box_center(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(F.floor((x1 + x2) / 2), F.floor((y1 + y2) / 2))


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y, x + w, y + h)


def smart_resize(height: Column, width: Column, least: int, most: int, factor: int = 28) -> Column:
    """(height, width) in multiples of ``factor``, scaled so that the area comes within bounds."""
    area = height * width
    scale = F.when(area < least, F.sqrt(F.lit(float(least)) / area)).when(area > most, F.sqrt(F.lit(float(most)) / area)).otherwise(1.0)
    side = lambda v: F.greatest(F.lit(factor), F.bround(v * scale / factor, 0) * factor).cast("int")
    return F.struct(side(height).alias("height"), side(width).alias("width"))


#: Start and end of a swipe on a grid of 1000 for each scroll direction (fixed values of the recordings' fallback).
FALLBACK_SWIPES = {"down": (500, 750, 500, 250), "up": (500, 250, 500, 750), "left": (250, 500, 750, 500), "right": (750, 500, 250, 500)}
#: The same in the benchmark's expected actions, with the direction the finger goes (fixed values of the benchmark).
EXPECTED_SWIPES = {"down": (500, 650, 500, 350), "up": (500, 350, 500, 650), "left": (650, 500, 350, 500), "right": (350, 500, 650, 500)}
FINGER = {"down": "up", "up": "down", "left": "left", "right": "right"}


def swipe_for_scroll(direction: Column, swipes: dict[str, tuple[int, ...]] = FALLBACK_SWIPES) -> Column:
    """array(x1, y1, x2, y2); null for an unknown direction."""
    out = None
    for name, swipe in swipes.items():
        ends = F.array(*[F.lit(v) for v in swipe])
        out = F.when(direction == name, ends) if out is None else out.when(direction == name, ends)
    return out


def any_collinear(points: Column) -> Column:
    """Whether three points of an array of (x, y) lie on one line, by the area of their triangle."""

    def area(a, b, c):
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def three(points: Column) -> Column:
        later = lambda i: F.slice(points, i + 2, F.size(points))
        of = lambda i, a: F.transform(later(i), lambda b, j: F.struct(b.alias("b"), (i + j + 1).alias("j")))
        pair = lambda i, a: F.exists(of(i, a), lambda p: F.exists(later(p["j"]), lambda c: F.abs(area(a, p["b"], c)) < 1e-9))
        each = F.transform(points, lambda a, i: F.struct(a.alias("a"), i.alias("i")))
        return F.exists(each, lambda x: pair(x["i"], x["a"]))

    return bound(points, lambda p: F.when(F.size(p) >= 3, three(p)).otherwise(False))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to the buffer's start, then falling in a line to -factor at the end."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def workload(length: Column, width: int = 24576) -> Column:
    """A sequence's cost: a linear and a quadratic part."""
    return length * width + length * length
