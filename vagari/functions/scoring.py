"""Scores of generated images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ScoreParams

HARD = ("quantity", "category", "direction", "distance", "scene")


def rounded(x: Column, digits: int) -> Column:
    """Half up on the decimal value: binary noise beyond nine digits goes first, so that 7.2749999999999995 counts as 7.275."""
    return F.round(F.round(x, 9), digits)


def hard_score(*parts: Column) -> Column:
    """Missing parts count 0."""
    out = F.lit(0.0)
    for p in parts:
        out = out + F.coalesce(p.cast("double"), F.lit(0.0))
    return out


def soft_score(score: Column) -> Column:
    """G09"""
    return F.coalesce(score.cast("double"), F.lit(0.0))


def composite(hard: Column, soft: Column, p: ScoreParams = ScoreParams()) -> Column:
    """Both scores on a unit scale, weighted. The scaled value comes from the final one before rounding."""
    h, s = hard / 5.0, (soft - 1.0) / 4.0
    final = F.lit(p.alpha) * h + F.lit(1 - p.alpha) * s
    return F.struct(rounded(h, 4).alias("s_hard_normalized"), rounded(s, 4).alias("s_soft_normalized"), rounded(final, 4).alias("score_final"), rounded(final * p.scale, 2).alias("score_final_scaled"))


def softmax(logits: Column) -> Column:
    """Shifted by the maximum."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def weighted(probabilities: Column, weights: Column) -> Column:
    """The weighted mean of the prompts' probabilities."""
    return F.aggregate(F.zip_with(probabilities, weights, lambda p, w: p * w), F.lit(0.0), lambda a, x: a + x)


def soft_final(weighted_score: Column, error: Column) -> Column:
    """1 to 5; 0 where scoring failed."""
    return F.when(error.isNotNull(), F.lit(0.0)).otherwise(F.lit(1.0) + weighted_score * 4.0)


def best_level(probabilities: Column, levels: Column) -> Column:
    """The first of the most likely levels, its probability, and all of them rounded."""
    at = F.array_position(probabilities, F.array_max(probabilities))
    return F.struct(F.get(levels, (at - 1).cast("int")).alias("predicted_level"), F.round(F.array_max(probabilities), 4).alias("confidence"), F.transform(probabilities, lambda x: F.round(x, 4)).alias("probabilities"))


def min_snr_weight(snr: Column, gamma: float, v_prediction: bool = False) -> Column:
    """G18"""
    return F.least(snr, F.lit(gamma)) / F.nullif(snr + 1.0 if v_prediction else snr, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """M14 offline: the logit of an image and a text is the product of their embeddings."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_draw(*parts: Column) -> Column:
    """A whole number from 0 to 2^32 - 1 from the md5 of the parts: sampling that every engine repeats."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column) -> Column:
    return hash_draw(*parts) / 4294967296.0
