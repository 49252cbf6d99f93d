"""Box arithmetic on columns. A box is (left, top, width, height)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four columns that form a box."""

    left: Column
    top: Column
    width: Column
    height: Column

    @property
    def right(self) -> Column:
        return self.left + self.width

    @property
    def bottom(self) -> Column:
        return self.top + self.height

    @property
    def area(self) -> Column:
        return self.width * self.height

    def columns(self, prefix: str = "") -> dict[str, Column]:
        return {prefix + n: getattr(self, n) for n in self._fields}


def box(prefix: str = "") -> Box:
    """The box held in the columns left, top, width and height."""
    return Box(*[F.col(prefix + n) for n in Box._fields])


def from_edges(left: Column, top: Column, right: Column, bottom: Column) -> Box:
    """Box between edges; a negative extent is zero."""
    zero = F.lit(0.0)
    return Box(left, top, F.greatest(zero, right - left), F.greatest(zero, bottom - top))


def expand(b: Box, padding, max_width: Column | None = None, max_height: Column | None = None) -> Box:
    """Grow a box on all sides, staying at or above 0 and below the maxima."""
    pad = padding if isinstance(padding, Column) else F.lit(float(padding))
    right, bottom = b.right + pad, b.bottom + pad
    if max_width is not None:
        right = F.least(max_width.cast("double"), right)
    if max_height is not None:
        bottom = F.least(max_height.cast("double"), bottom)
    return from_edges(F.greatest(F.lit(0.0), b.left - pad), F.greatest(F.lit(0.0), b.top - pad), right, bottom)


def contains(outer: Box, inner: Box) -> Column:
    return (
        (outer.left <= inner.left)
        & (outer.top <= inner.top)
        & (outer.right >= inner.right)
        & (outer.bottom >= inner.bottom)
    )


def together(a: Box, b: Box, gap_x: float, gap_y: float) -> Column:
    """Whether b belongs to a: their shadows on an axis overlap, their tops are level, or b follows closely below
    or beside a. A box inside another of at least 1.4 times its area stays apart."""
    across = F.least(a.right, b.right) - F.greatest(a.left, b.left)
    down = F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)
    below, beside = b.top - a.bottom, b.left - a.right
    nested = (contains(a, b) | contains(b, a)) & (F.greatest(a.area, b.area) >= 1.4 * F.least(a.area, b.area))
    return ~nested & (
        (F.greatest(across, down) > 0)
        | (F.abs(b.top - a.top) <= gap_y)
        | (below.between(0, gap_y) & (across > -gap_x))
        | (beside.between(0, gap_x) & (down > -gap_y))
    )


def polygon_box(points: Column) -> Box:
    """Axis-aligned box of an array of (x, y) points (P5)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return from_edges(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
