"""Box and plane geometry as Column expressions. A box is a struct (x, y, w, h); a homography an array of nine doubles, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A homogeneous coordinate nearer to zero than this has no place in the plane.
FLAT = 1e-9


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    return w * h


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def containment(inner: Column, outer: Column) -> Column:
    """Share of `inner` that lies in `outer`; 0 for an empty box."""
    return F.coalesce(F.try_divide(overlap(inner, outer), area(inner).cast("double")), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 for empty ones."""
    both = overlap(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def centre_distance(a: Column, b: Column) -> Column:
    dx = a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2
    dy = a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2
    return F.sqrt(dx * dx + dy * dy)


def normalised(a: Column, width: Column, height: Column) -> Column:
    """The box in shares of an image's width and height."""
    share = lambda part, whole: F.try_divide(part.cast("double"), whole.cast("double"))
    return F.struct(share(a["x"], width).alias("x"), share(a["y"], height).alias("y"), share(a["w"], width).alias("w"), share(a["h"], height).alias("h"))


def transform_point(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a homography; NaN where the point goes to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    over = lambda top: F.when(F.abs(w) < FLAT, F.lit(float("nan"))).otherwise(top / w)
    return F.struct(over(m[0] * x + m[1] * y + m[2]).alias("x"), over(m[3] * x + m[4] * y + m[5]).alias("y"))


def transform_box(m: Column, box: Column) -> Column:
    """The upright box around a box's four corners under a homography."""
    corners = [transform_point(m, box["x"] + i * box["w"], box["y"] + j * box["h"]) for i in (0, 1) for j in (0, 1)]
    xs, ys = ([c[k] for c in corners] for k in ("x", "y"))
    x, y = F.least(*xs), F.least(*ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(*xs) - x).alias("w"), (F.greatest(*ys) - y).alias("h"))


def inverse(m: Column) -> Column:
    """The inverse homography by its adjugate; null if there is none."""
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    det = m[0] * minor(4, 5, 7, 8) - m[1] * minor(3, 5, 6, 8) + m[2] * minor(3, 4, 6, 7)
    cells = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    return F.when(F.abs(det) >= 1e-12, F.array(*(c / det for c in cells)))


def millimetres(pixels: Column, pixels_per_mm: Column) -> Column:
    """A length in mm; null without a positive calibration."""
    return F.when(pixels_per_mm > 0, pixels / pixels_per_mm)


def panel_area(height: Column, width: Column, circumference: Column | None = None) -> Column:
    """Principal display panel: height times width, or 40 % of height times circumference for a round package."""
    flat = height * width
    return flat if circumference is None else F.coalesce(0.4 * height * circumference, flat)


def relative_uncertainty(*shares: Column) -> Column:
    """Independent relative errors added in quadrature; null if one is."""
    total = F.lit(0.0)
    for s in shares:
        total = total + s * s
    return F.sqrt(total)


def rotation(degrees: float, x: float = 0.0, y: float = 0.0) -> Column:
    """The homography that turns by an angle, then moves by (x, y)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return F.array(*(F.lit(float(v)) for v in (c, -s, x, s, c, y, 0, 0, 1)))
