"""Rectangles (left, right, top, bottom; y grows upwards) as structs."""

from pyspark.sql import functions as F


def rect(left, right, top, bottom):
    return F.struct(left.cast("double").alias("left"), right.cast("double").alias("right"), top.cast("double").alias("top"), bottom.cast("double").alias("bottom"))


def area(r):
    return F.greatest(r["right"] - r["left"], F.lit(0.0)) * F.greatest(r["top"] - r["bottom"], F.lit(0.0))


def meet(a, b):
    return rect(F.greatest(a["left"], b["left"]), F.least(a["right"], b["right"]), F.least(a["top"], b["top"]), F.greatest(a["bottom"], b["bottom"]))


def union(a, b):
    return rect(F.least(a["left"], b["left"]), F.greatest(a["right"], b["right"]), F.greatest(a["top"], b["top"]), F.least(a["bottom"], b["bottom"]))


def overlap_ratio(a, b):
    """Intersection over union; 0 where both are empty."""
    both = area(meet(a, b))
    all_ = area(a) + area(b) - both
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def contains(a, b):
    return (a["left"] <= b["left"]) & (a["right"] >= b["right"]) & (a["top"] >= b["top"]) & (a["bottom"] <= b["bottom"])


def nan_max(a, b):
    """NaN if either is."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.greatest(a, b))


def nan_min(a, b):
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))
