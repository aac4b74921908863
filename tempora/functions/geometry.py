"""Rectangles with half-open pixel bounds: x1 <= x < x2, y1 <= y < y2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])


def valid(b: Box, width: float, height: float) -> Column:
    """Finite, ordered and inside the frame."""
    numbers = [~F.isnan(c) & c.isNotNull() for c in b]
    return numbers[0] & numbers[1] & numbers[2] & numbers[3] & (b.x1 >= 0) & (b.y1 >= 0) & (b.x1 < b.x2) & (b.y1 < b.y2) & (b.x2 <= width) & (b.y2 <= height)


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def overlap(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return w * h


def iou(a: Box, b: Box) -> Column:
    shared = overlap(a, b)
    return F.try_divide(shared, area(a) + area(b) - shared)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def expand(b: Box, share: float, width: int, height: int) -> Box:
    """Moved outwards by a share of its size, to whole pixels, and clipped to the frame."""
    dx, dy = (b.x2 - b.x1) * share, (b.y2 - b.y1) * share
    return Box(F.greatest(F.lit(0), F.floor(b.x1 - dx)), F.greatest(F.lit(0), F.floor(b.y1 - dy)), F.least(F.lit(width), F.ceil(b.x2 + dx)), F.least(F.lit(height), F.ceil(b.y2 + dy)))


def into_crop(b: Box, crop: Box, scale: float = 1.0) -> Box:
    """Frame coordinates to those of a crop."""
    return Box((b.x1 - crop.x1) * scale, (b.y1 - crop.y1) * scale, (b.x2 - crop.x1) * scale, (b.y2 - crop.y1) * scale)


def out_of_crop(b: Box, crop: Box, scale: float = 1.0) -> Box:
    return Box(b.x1 / scale + crop.x1, b.y1 / scale + crop.y1, b.x2 / scale + crop.x1, b.y2 / scale + crop.y1)


def centre_distance(a: Box, b: Box) -> Column:
    """Squared distance of the centres."""
    dx, dy = (a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, (a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2
    return dx * dx + dy * dy


def size_class(b: Box, small_area: float = 1024.0) -> Column:
    return F.when(area(b) < small_area, "small").otherwise("larger")
