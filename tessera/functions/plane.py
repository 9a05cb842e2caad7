"""Points and boxes of an image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Edges count as inside; null if anything is missing."""
    known = x.isNotNull() & y.isNotNull() & width.isNotNull() & height.isNotNull()
    return F.when(known, (x >= 0) & (y >= 0) & (x <= width) & (y <= height))


def outside_by(x: Column, y: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    away = F.hypot(F.greatest(-x, x - width, zero), F.greatest(-y, y - height, zero))
    return F.when(x.isNotNull() & y.isNotNull() & width.isNotNull() & height.isNotNull(), away)


def visible_share(x: Column, y: Column, to_x: Column, to_y: Column, width: Column, height: Column) -> Column:
    """How far along the way from a point inside to another one the box's edge lies (at most 1); null if it is never met."""

    def meet(start: Column, step: Column, edge: Column, other: Column, other_step: Column, most: Column) -> Column:
        t = F.try_divide(edge - start, step)
        across = other + t * other_step
        return F.when((F.abs(step) > EPS) & (t > EPS) & (across >= -EPS) & (across <= most + EPS), t)

    dx, dy, zero = to_x - x, to_y - y, F.lit(0.0)
    hits = F.array_compact(F.array(meet(x, dx, zero, y, dy, height), meet(x, dx, width, y, dy, height), meet(y, dy, zero, x, dx, width), meet(y, dy, height, x, dx, width)))
    return F.least(F.array_min(hits), F.when(F.size(hits) > 0, F.lit(1.0)))


def edge_met(x: Column, y: Column, to_x: Column, to_y: Column, width: Column, height: Column) -> Column:
    """Where the way from a point inside to another one meets the box's edge first, as (t, x, y): t is its share of the way and may pass 1. Null if it never does."""

    def meet(start: Column, step: Column, edge: Column, other: Column, other_step: Column, most: Column, upright: bool) -> Column:
        t = F.try_divide(edge - start, step)
        across = other + t * other_step
        along = F.least(F.greatest(across, F.lit(0.0)), most)
        point = F.struct(t.alias("t"), *((edge.alias("x"), along.alias("y")) if upright else (along.alias("x"), edge.alias("y"))))
        return F.when((F.abs(step) > 1e-12) & (t > EPS) & (across >= -1e-6) & (across <= most + 1e-6), point)

    dx, dy, zero = to_x - x, to_y - y, F.lit(0.0)
    met = F.array(meet(x, dx, zero, y, dy, height, True), meet(x, dx, width, y, dy, height, True), meet(y, dy, zero, x, dx, width, False), meet(y, dy, height, x, dx, width, False))
    return F.array_min(F.array_compact(met))


def axis_degrees(x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    return F.degrees(F.atan2(to_y - y, to_x - x))


def millimetres(px: Column, px_per_mm: Column) -> Column:
    return F.when(px_per_mm > 0, px / px_per_mm)


def padded_region(low_x: Column, low_y: Column, high_x: Column, high_y: Column, width: Column, height: Column, least: float = 24.0, share: float = 0.35) -> list[Column]:
    """A box around points, padded by a share of its longer side, inside the image."""
    pad = F.greatest(F.lit(least), share * F.greatest(high_x - low_x, high_y - low_y))
    zero = F.lit(0.0)
    return [F.greatest(low_x - pad, zero), F.greatest(low_y - pad, zero), F.least(high_x + pad, width), F.least(high_y + pad, height)]


def whole_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, least: int = 4) -> list[Column]:
    """Outward to whole pixels, inside the image, with sides of at least `least`: the far edge moves first, then the near one."""
    left, top = F.greatest(F.floor(x1), F.lit(0)), F.greatest(F.floor(y1), F.lit(0))
    right, bottom = F.least(F.ceil(x2), width), F.least(F.ceil(y2), height)
    right, bottom = F.least(F.greatest(right, left + least), width), F.least(F.greatest(bottom, top + least), height)
    return [F.greatest(F.least(left, right - least), F.lit(0)), F.greatest(F.least(top, bottom - least), F.lit(0)), right, bottom]


def centered_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Box (x1, y1, x2, y2) of whole pixels around a center, halves to even, inside the image and one pixel wide at least."""

    def side(middle: Column, length: Column, most: Column) -> tuple[Column, Column]:
        low = F.greatest(F.lit(0), F.least(most - 1, F.bround(middle - length / 2).cast("int")))
        high = F.greatest(F.lit(1), F.least(most, F.bround(middle + length / 2).cast("int")))
        return low, F.when(high <= low, F.least(most, low + 1)).otherwise(high)

    (x1, x2), (y1, y2) = side(x, w, width), side(y, h, height)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: Column, least: int = 4) -> Column:
    """Padded box outward to whole pixels inside the image; null if a side is then shorter than `least`."""
    low = lambda a, b: F.greatest(F.lit(0), F.floor(F.least(a, b) - pad))
    high = lambda a, b, most: F.least(most, F.ceil(F.greatest(a, b) + pad))
    left, top, right, bottom = low(x1, x2), low(y1, y2), high(x1, x2, width), high(y1, y2, height)
    box = F.struct(*(c.cast("long").alias(n) for c, n in zip((left, top, right, bottom), ("x1", "y1", "x2", "y2"), strict=True)))
    there = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(there & (right - left >= least) & (bottom - top >= least), box)


def head_box(roi: Column, base_x: Column, base_y: Column, tip_x: Column, tip_y: Column, length: Column, width: Column, height: Column) -> Column:
    """Crop around what there is of a head region (x1, y1, x2, y2) and the two ends of a bill."""
    pair = lambda x, y, c: F.when(x.isNotNull() & y.isNotNull(), c)
    xs = F.array_compact(F.array(roi["x1"], roi["x2"], pair(base_x, base_y, base_x), pair(tip_x, tip_y, tip_x)))
    ys = F.array_compact(F.array(roi["y1"], roi["y2"], pair(base_x, base_y, base_y), pair(tip_x, tip_y, tip_y)))
    low_x, high_x, low_y, high_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    span = F.greatest(high_x - low_x, high_y - low_y)
    pad = F.greatest(F.lit(6.0), 0.12 * F.greatest(width, height), 0.25 * span, 0.35 * length)
    return crop_box(low_x, low_y, high_x, high_y, width, height, pad)


def body_box(roi: Column, width: Column, height: Column) -> Column:
    span = F.greatest(F.abs(roi["x2"] - roi["x1"]), F.abs(roi["y2"] - roi["y1"]))
    pad = F.greatest(F.lit(6.0), 0.10 * span, 0.05 * F.greatest(width, height))
    return crop_box(roi["x1"], roi["y1"], roi["x2"], roi["y2"], width, height, pad)
