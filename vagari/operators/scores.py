"""Operators on hard and soft scores: positional joins, consistency, statistics, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import scoring as sc
from ..functions.lexicons import LEVELS
from ..params import ScoreParams
from .ordering import numbered


def paired(hard: DataFrame, soft: DataFrame) -> DataFrame:
    """images of both results at one model, sentence and image position. Models and positions of one side only have no row."""
    return hard.join(soft, ["model", "sentence_idx", "image_idx"])


def scored(images: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """G10 on rows with hard_score and soft_score."""
    return images.withColumn("c", sc.composite(F.col("hard_score"), F.col("soft_score"), p)).select("*", "c.*").drop("c")


def consistency(images: DataFrame, keys: list[str], column: str = "score_final_scaled") -> DataFrame:
    """A01 by keys: mean, sample deviation (0 for one score), cv and consistency; a mean of 0 has cv and consistency 0."""
    mean, std = F.avg(column), F.coalesce(F.stddev_samp(column), F.lit(0.0))
    stats = images.groupBy(*keys).agg(mean.alias("m"), std.alias("s"))
    cv = F.when(F.col("m") == 0, 0.0).otherwise(F.try_divide("s", "m"))
    good = F.when(F.col("m") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.try_divide("s", "m")))
    return stats.select(*keys, sc.rounded(F.col("m"), 4).alias("mean"), sc.rounded(F.col("s"), 4).alias("std"), sc.rounded(cv, 4).alias("cv"), sc.rounded(good, 4).alias("consistency"))


def pass_rate(images: DataFrame, keys: list[str], p: ScoreParams = ScoreParams(), column: str = "score_final_scaled") -> DataFrame:
    """A02 by keys."""
    ok = F.col(column) >= p.pass_threshold
    return images.groupBy(*keys).agg(sc.rounded(F.min(column), 2).alias("min_score"), F.bool_and(ok).alias("all_pass"), F.count_if(ok).alias("pass_count"), sc.rounded(F.count_if(ok) / F.count("*"), 4).alias("pass_rate"))


def model_statistics(images: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """Image-level means and population deviations, sentence-level consistency and pass rate. One pass over sentences feeds the second grain."""
    keys = ["model", "sentence_idx"]
    sentences = consistency(images, keys).join(pass_rate(images, keys, p), keys)
    by_sentence = sentences.groupBy("model").agg(F.count("*").alias("total_sentences"), sc.rounded(F.avg("consistency"), 4).alias("avg_consistency_cv"), F.count_if("all_pass").alias("sentence_pass_count"))
    measures = {"composite": "score_final_scaled", "hard": "hard_score", "soft": "soft_score"}
    aggs = [F.count("*").alias("total_images")]
    for name, c in measures.items():
        aggs += [sc.rounded(F.avg(c), 2).alias(f"avg_{name}_score"), sc.rounded(F.stddev_pop(c), 2).alias(f"std_{name}_score")]
    rate = sc.rounded(F.col("sentence_pass_count") / F.col("total_sentences"), 4)
    return images.groupBy("model").agg(*aggs).join(by_sentence, "model").withColumn("sentence_pass_rate", rate)


def ranked(statistics: DataFrame) -> DataFrame:
    """By composite mean, equal means by name. One row per model."""
    return statistics.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("avg_composite_score"), "model")))


def contact_statistics(checks: DataFrame) -> DataFrame:
    """A04 and A05 by model."""
    l1, known = F.col("contact_expected"), F.col("predicted_level") != "Unknown"
    share = lambda a, b: F.coalesce(sc.rounded(F.try_divide(a, b), 4), F.lit(0.0))
    out = checks.groupBy("model").agg(
        F.count_if(l1).alias("l1_total"),
        F.count_if(l1 & F.col("pass_contact_check")).alias("l1_correct"),
        F.count_if(known).alias("total"),
        F.count_if(known & (F.col("predicted_level") == F.col("level"))).alias("correct"),
    )
    return out.withColumn("l1_accuracy", share("l1_correct", "l1_total")).withColumn("accuracy", share("correct", "total"))


def levels(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")


def per_level_accuracy(checks: DataFrame) -> DataFrame:
    """Every model with all three levels."""
    own = checks.filter(F.col("predicted_level") != "Unknown").groupBy("model", "level").agg(F.count("*").alias("n"), F.count_if(F.col("predicted_level") == F.col("level")).alias("c"))
    domain = checks.select("model").distinct().withColumn("level", F.explode(F.array(*(F.lit(x) for x in LEVELS))))
    return domain.join(own, ["model", "level"], "left").select("model", "level", F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("c", F.lit(0)).alias("correct"), F.coalesce(sc.rounded(F.try_divide("c", "n"), 4), F.lit(0.0)).alias("accuracy"))


def confusion(checks: DataFrame) -> DataFrame:
    """Rows true level, columns predicted level, in percent of the row; rows without images are 0."""
    known = checks.filter(F.col("predicted_level").isin(LEVELS) & F.col("level").isin(LEVELS))
    counts = known.groupBy("level").pivot("predicted_level", LEVELS).count()
    counts = levels(checks).join(counts, "level", "left").na.fill(0, LEVELS)
    total = F.col("L1") + F.col("L2") + F.col("L3")
    return counts.select("level", *(F.col(x).alias(f"n_{x}") for x in LEVELS), *(F.coalesce(sc.rounded(100 * F.try_divide(F.col(x), total), 4), F.lit(0.0)).alias(f"pct_{x}") for x in LEVELS))


def score_summary(scores: DataFrame) -> DataFrame:
    """A11, P09 by model over rows without error; models without any have nulls."""
    ok = F.when(F.col("error").isNull(), F.col("clip_score"))
    return scores.groupBy("model").agg(
        F.count("*").alias("total_images"), F.count(ok).alias("valid"), F.count("error").alias("errors"),
        sc.rounded(F.avg(ok), 4).alias("average"), sc.rounded(F.stddev_pop(ok), 4).alias("deviation"), F.max(ok).alias("highest"), F.min(ok).alias("lowest"),
    )


def score_histogram(scores: DataFrame) -> DataFrame:
    """A10: five bins [1,2) to [5,6) by model, also empty ones; scores below 1 fall in none but count in the percentage."""
    valid = scores.filter(F.col("error").isNull())
    totals = valid.groupBy("model").agg(F.count("*").alias("n"))
    bins = valid.groupBy("model", F.floor("clip_score").cast("int").alias("bin")).agg(F.count("*").alias("c"))
    domain = totals.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return domain.join(bins, ["model", "bin"], "left").select("model", "bin", F.coalesce("c", F.lit(0)).alias("count"), sc.rounded(100 * F.coalesce("c", F.lit(0)) / F.col("n"), 4).alias("percentage"))


def dimension_averages(scores: DataFrame) -> DataFrame:
    """A12"""
    return scores.select("model", F.explode("dimension_scores").alias("dimension", "score")).groupBy("model", "dimension").agg(sc.rounded(F.avg("score"), 6).alias("average"))


def box_plot(images: DataFrame, column: str = "score_final_scaled", key: str = "image_id") -> DataFrame:
    """What a box plot of each model shows. Quartiles lie between the rows at their places, so no task holds a model's scores; null scores don't count, and a model without scores has no row."""
    placed = numbered(images.filter(F.col(column).isNotNull()).select("model", F.col(column).alias("x"), key), ["model", "x", key], "nth")
    models = placed.groupBy("model").agg(F.min("nth").alias("first"), F.count("*").alias("n"), F.avg("x").alias("m"))
    rows = placed.join(models, "model").withColumn("place", F.col("nth") - F.col("first"))
    sought = {q: (F.col("n") - 1) * share for q, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("x")))
    ends = rows.groupBy("model", "n", "m").agg(*(at(f(p)).alias(f"{q}_{name}") for q, p in sought.items() for name, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda q, p: F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * (p - F.floor(p))
    return ends.select("model", *(sc.rounded(between(q, p), 6).alias(q) for q, p in sought.items()), sc.rounded(F.col("m"), 6).alias("mean"))
