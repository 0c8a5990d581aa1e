"""Box arithmetic as column expressions, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def area(a: str) -> Column:
    return (_c(a, "x2") - _c(a, "x1")) * (_c(a, "y2") - _c(a, "y1"))


def intersection(a: str, b: str) -> Column:
    w = F.least(_c(a, "x2"), _c(b, "x2")) - F.greatest(_c(a, "x1"), _c(b, "x1"))
    h = F.least(_c(a, "y2"), _c(b, "y2")) - F.greatest(_c(a, "y1"), _c(b, "y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    i = intersection(a, b)
    return i / (area(a) + area(b) - i + EPS)


def inside(a: str, b: str) -> Column:
    """Share of box a within box b."""
    return intersection(a, b) / (area(a) + EPS)


def iou_sql(a: str, b: str) -> str:
    i = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0)"
    size = lambda s: f"({s}.x2 - {s}.x1) * ({s}.y2 - {s}.y1)"
    return f"(({i}) / ({size(a)} + {size(b)} - ({i}) + 1e-9))"
