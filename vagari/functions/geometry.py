"""Boxes as structs of x1, y1, x2, y2."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ContactParams
from .lexicons import CONTACT_REASONS as R
from .text import fixed

SIDES = ("x1", "y1", "x2", "y2")


def box(*sides: Column) -> Column:
    return F.struct(*(s.cast("double").alias(n) for n, s in zip(SIDES, sides, strict=True)))


def scaled(b: Column, width: Column, height: Column) -> Column:
    """From shares of the image to pixels."""
    return box(b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height)


def normalised(b: Column, width: Column, height: Column) -> Column:
    """From pixels to shares of the image."""
    return box(b["x1"] / width, b["y1"] / height, b["x2"] / width, b["y2"] / height)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column, only_positive: bool = False) -> Column:
    """Boxes that only touch have overlap 0; union 0 gives 0. G04 (only_positive): a negative union gives 0 too."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = w * h
    union = area(a) + area(b) - both
    usable = union > 0 if only_positive else union != 0
    return F.when((w < 0) | (h < 0) | ~usable, F.lit(0.0)).otherwise(both / F.when(usable, union))


def distance(a: Column, b: Column) -> Column:
    """0 for boxes that overlap or touch, else the length of the gap."""
    dx = F.greatest(F.lit(0.0), a["x1"] - b["x2"], b["x1"] - a["x2"])
    dy = F.greatest(F.lit(0.0), a["y1"] - b["y2"], b["y1"] - a["y2"])
    return F.sqrt(dx * dx + dy * dy)


def contact(overlap: Column, gap: Column, p: ContactParams = ContactParams()) -> Column:
    """G06"""
    return (overlap > p.iou) | (gap < p.pixels)


def contact_reason(level: Column, detected: Column, overlap: Column, gap: Column, p: ContactParams = ContactParams()) -> Column:
    """T24. Decimals are rounded as C does; an endless gap is inf."""

    def say(key: str, *values: Column) -> Column:
        texts = [F.coalesce(fixed(F.when(x < 1e15, x), int(digits)), F.lit("inf")) for x, digits in zip(values, re.findall(r"%\.(\d)f", R[key]), strict=True)]
        return F.format_string(re.sub(r"%\.\df", "%s", R[key]), *texts)

    by_level = {
        "L1": F.when(detected & (overlap > 0), say("L1 overlap", overlap)).when(detected, say("L1 near", gap)).otherwise(say("L1 none", overlap, gap)),
        "L2": F.when(overlap > 0, say("L2 overlap", overlap)).when(gap < p.grazing_px, say("L2 grazing", gap)).otherwise(say("L2 gap", gap)),
        "L3": F.when(gap < p.near_px, say("L3 near", gap)).otherwise(say("L3 far", gap)),
    }
    out = F.lit(R["unknown"])
    for name, text in by_level.items():
        out = F.when(level == name, text).otherwise(out)
    return out


def check_contact(two: Column, overlap: Column, gap: Column, level: Column, p: ContactParams = ContactParams()) -> Column:
    """Of an image's first two boxes, with their overlap and gap as columns; fewer than two fail at every level, with an infinite gap."""
    expected = level == "L1"
    detected = contact(overlap, gap, p)
    return F.struct(
        level.alias("level"),
        expected.alias("contact_expected"),
        (two & F.coalesce(detected, F.lit(False))).alias("contact_detected"),
        F.when(two, F.round(overlap, 4)).otherwise(F.lit(0.0)).alias("iou"),
        F.when(two, F.round(gap, 2)).otherwise(F.lit(float("inf"))).alias("pixel_distance"),
        (two & F.coalesce(~expected | detected, F.lit(False))).alias("pass_contact_check"),
        F.when(two, contact_reason(level, detected, overlap, gap, p)).otherwise(R["single"]).alias("reason"),
    )
