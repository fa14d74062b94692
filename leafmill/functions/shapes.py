"""Boxes as arrays ``[x0, y0, x1, y1]``, in points, y growing downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corner(box: Column, k: int) -> Column:
    return F.get(box, F.lit(k))


def area(box: Column) -> Column:
    """The area of a box; 0 for one that is turned inside out."""
    return F.greatest(corner(box, 2) - corner(box, 0), F.lit(0.0)) * F.greatest(corner(box, 3) - corner(box, 1), F.lit(0.0))


def common(a: Column, b: Column) -> Column:
    """The box that two boxes share; of no area if they are apart."""
    return F.array(*[(F.greatest if k < 2 else F.least)(corner(a, k), corner(b, k)) for k in range(4)])


def around(a: Column, b: Column) -> Column:
    """The least box that holds both."""
    return F.array(*[(F.least if k < 2 else F.greatest)(corner(a, k), corner(b, k)) for k in range(4)])


def overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share some area."""
    return area(common(a, b)) > 0


def union_area(boxes: Column) -> Column:
    """The area that the boxes of an array cover together, each place once.

    Strips between neighbouring x edges; in a strip the parts of each box that
    no box above it has covered.
    """
    fair = F.filter(boxes, lambda b: area(b) > 0)
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform(fair, lambda b: F.array(corner(b, 0), corner(b, 2))))))
    strips = F.transform(F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("low"), F.get(edges, i + 1).alias("high")))

    def covered(s: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(fair, lambda b: (corner(b, 0) < s["high"]) & (corner(b, 2) > s["low"])), lambda b: F.struct(corner(b, 1).alias("top"), corner(b, 3).alias("end"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("to"))
        return F.aggregate(
            spans,
            start,
            lambda acc, b: F.struct((acc["sum"] + F.greatest(b["end"] - F.greatest(b["top"], acc["to"]), F.lit(0.0))).alias("sum"), F.greatest(acc["to"], b["end"]).alias("to")),
            lambda acc: acc["sum"],
        )

    return F.aggregate(strips, F.lit(0.0), lambda total, s: total + (s["high"] - s["low"]) * covered(s))


def turned(box: Column, turn: Column, width: Column, height: Column) -> Column:
    """A box of an unturned page of ``width`` by ``height`` on the page as it is shown, turned by 90 degrees or more of it."""
    x0, y0, x1, y1 = (corner(box, k) for k in range(4))
    return (
        F.when(turn == 90, F.array(height - y1, x0, height - y0, x1))
        .when(turn == 180, F.array(width - x1, height - y1, width - x0, height - y0))
        .when(turn == 270, F.array(y0, width - x1, y1, width - x0))
        .otherwise(box)
    )


def edges_within(edges: Column, span: Column) -> Column:
    """How many rows or columns a span of ``[low, high]`` covers, by the different edges inside it; one at least."""
    whole = F.array_distinct(F.transform(edges, lambda x: F.round(x)))
    inside = F.filter(whole, lambda x: (x > F.round(F.get(span, F.lit(0)))) & (x < F.round(F.get(span, F.lit(1)))))
    return (F.size(inside) + 1).cast("int")


def crop(box: Column, page: Column, pad: float = 18.0) -> Column:
    """A box with ``pad`` points round it, within its page."""
    wide = F.transform(box, lambda v, k: F.when(k < 2, v - pad).otherwise(v + pad))
    return common(wide, page)


def within_crop(box: Column, frame: Column) -> Column:
    """A box as shares (0 to 1) of the crop it is in, to thousandths."""
    w, h = corner(frame, 2) - corner(frame, 0), corner(frame, 3) - corner(frame, 1)
    return F.transform(box, lambda v, k: F.round(F.when(k % 2 == 0, (v - corner(frame, 0)) / w).otherwise((v - corner(frame, 1)) / h), 3))
