"""Predicates on plane points as Column expressions; a point is a struct with x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest distance in pixels, largest relative error of a ratio, and what counts as no length (fixed values).
NEAR, RATIO_ERROR, NOTHING = 1.0, 0.02, 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _to(a: Column, b: Column) -> tuple[Column, Column]:
    return b["x"] - a["x"], b["y"] - a["y"]


def _length(v: tuple[Column, Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1])


def _cross(u: tuple[Column, Column], v: tuple[Column, Column]) -> Column:
    return u[0] * v[1] - u[1] * v[0]


def _dot(u: tuple[Column, Column], v: tuple[Column, Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1]


def _turned(product: Column, u: tuple[Column, Column], v: tuple[Column, Column]) -> Column:
    """Whether a product of two directions moves the longer one's end by less than ``NEAR``."""
    a, b = _length(u), _length(v)
    return F.when((a < NOTHING) | (b < NOTHING), False).otherwise(F.abs(product) / (a * b) * F.greatest(a, b) < NEAR)


def parallel(a: Column, b: Column, c: Column, d: Column) -> Column:
    u, v = _to(a, b), _to(c, d)
    return _turned(_cross(u, v), u, v)


def perpendicular(a: Column, b: Column, c: Column, d: Column) -> Column:
    u, v = _to(a, b), _to(c, d)
    return _turned(_dot(u, v), u, v)


def midpoint(m: Column, a: Column, b: Column) -> Column:
    return _length(((a["x"] + b["x"]) / 2 - m["x"], (a["y"] + b["y"]) / 2 - m["y"])) < NEAR


def on_line(p: Column, a: Column, b: Column) -> Column:
    line = _to(a, b)
    size = _length(line)
    return F.when(size < NOTHING, False).otherwise(F.abs(_cross(line, _to(a, p))) / size < NEAR)


def on_segment(p: Column, a: Column, b: Column) -> Column:
    line = _to(a, b)
    size = _length(line)
    share, margin = _dot(_to(a, p), line) / (size * size), NEAR / size
    return F.when(size < NOTHING, False).otherwise(on_line(p, a, b) & (share >= -margin) & (share <= 1 + margin))


def intersection(p: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the lines ab and cd meet at p; parallel lines don't."""
    u, v = _to(a, b), _to(c, d)
    turn = _cross(u, v)
    t = _cross(_to(a, c), v) / turn
    return F.when(F.abs(turn) < NOTHING, False).otherwise(_length((a["x"] + t * u[0] - p["x"], a["y"] + t * u[1] - p["y"])) < NEAR)


def ratio(a: Column, b: Column, c: Column, d: Column, expected: Column) -> Column:
    """Whether |ab| / |cd| is as expected, in relation to that unless it is 0."""
    below = _length(_to(c, d))
    error = F.abs(_length(_to(a, b)) / below - expected) / F.when(expected == 0, 1.0).otherwise(F.abs(expected))
    return F.when(below < NOTHING, False).otherwise(error < RATIO_ERROR)


def collinear(a: Column, b: Column, c: Column) -> Column:
    """Whether the height over the longest side is small; coinciding points are on a line."""
    u, v = _to(a, b), _to(a, c)
    longest = F.greatest(_length(u), _length(v), _length(_to(b, c)))
    return F.when(longest < NOTHING, True).otherwise(F.abs(_cross(u, v)) / longest < NEAR)
