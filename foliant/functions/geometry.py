"""Boxes as struct<x0,y0,x1,y1:double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def from_array(a: Column) -> Column:
    """Null unless the array holds exactly four numbers."""
    return F.when(F.size(a) == 4, F.struct(*[F.get(a, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Area that both boxes cover."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def contained(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies in the outer one."""
    own = area(inner)
    return F.when(own > 0, overlap(inner, outer) / own).otherwise(0.0)


def center(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def center_inside(inner: Column, outer: Column, tolerance: float = 20.0) -> Column:
    x, y = center(inner)
    return x.between(outer["x0"] - tolerance, outer["x1"] + tolerance) & y.between(outer["y0"] - tolerance, outer["y1"] + tolerance)


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def union_all(b: str) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return F.struct(F.min(f"{b}.x0").alias("x0"), F.min(f"{b}.y0").alias("y0"), F.max(f"{b}.x1").alias("x1"), F.max(f"{b}.y1").alias("y1"))


def column_of(page_width: Column, x0: Column, x1: Column) -> Column:
    """2 where the box is wider than 60 % of the page, else the half in which it starts."""
    return F.when(x1 - x0 > page_width * 0.6, 2).when(x0 < page_width / 2, 0).otherwise(1)
