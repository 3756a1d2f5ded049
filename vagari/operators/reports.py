"""Text reports as rows of lines: what the summaries of scores, models and levels say, whatever the number of sentences and the length of names.

A report is a table of lines with the keys that order it; no task holds a whole
report. Written in that order, its lines are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..params import ScoreParams
from . import scores as ops

RULE, THIN, SHORT = "=" * 80, "-" * 80, "-" * 40


def padded(c: Column, width: int) -> Column:
    """c with spaces behind it up to a width; longer values stay whole."""
    return F.rpad(c, F.greatest(F.length(c), F.lit(width)), F.lit(" "))


def number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", sc.rounded(c, digits))


def percent(c: Column, digits: int = 2) -> Column:
    return F.concat(number(100 * c, digits), F.lit("%"))


def said(*parts) -> Column:
    """Texts and columns one after another."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def lines(*texts) -> Column:
    return F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts))


def soft_summary(scores: DataFrame) -> DataFrame:
    """Part (0: head, 1: models), model, line, text, ordered by these, from rows of model, clip_score, error and dimension_scores.

    Rows with an error aren't scores; a model without any score has one line that
    says so. Scores below 1 are in no bin but count in the percentage. A null
    score without error counts as 0.
    """
    valid = scores.filter("error IS NULL").withColumn("clip_score", F.coalesce("clip_score", F.lit(0.0)))
    bins = [F.count_if((F.col("clip_score") >= b) & (F.col("clip_score") < b + 1)).alias(f"bin{b}") for b in range(1, 6)]
    own = valid.groupBy("model").agg(F.count("*").alias("valid"), F.avg("clip_score").alias("mean"), F.stddev_pop("clip_score").alias("deviation"), F.max("clip_score").alias("high"), F.min("clip_score").alias("low"), *bins)
    dims = valid.select("model", F.explode("dimension_scores").alias("dimension", "score")).groupBy("model", "dimension").agg(F.avg("score").alias("score"))
    told = F.struct("dimension", said("  ", F.col("dimension"), ": ", number(F.col("score"), 4)).alias("text"))
    dims = dims.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(told)), lambda d: d["text"]).alias("dims"))
    rows = scores.groupBy("model").agg(F.count("*").alias("images"), F.count("error").alias("errors")).join(own, "model", "left").join(dims, "model", "left")

    def bar(b: int) -> Column:
        n, share = F.col(f"bin{b}"), 100 * F.col(f"bin{b}") / F.col("valid")
        count, share_text = n.cast("string"), number(share, 1)
        left = lambda c, width: F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit(" "))
        return said(f"  {b}-{b + 1} points: ", left(count, 3), " (", left(share_text, 5), "%) ", F.repeat(F.lit("█"), F.floor(share / 2).cast("int")))

    begin = lines("", RULE, said("Model: ", F.col("model")), THIN)
    whole = F.concat(
        lines(said("Total images: ", F.col("images")), said("Valid scores: ", F.col("valid")), said("Evaluation errors: ", F.col("errors")), said("Average score: ", number(F.col("mean"), 2), "/5.0"), said("Standard deviation: ", number(F.col("deviation"), 2)), "", "Score distribution:", *(bar(b) for b in range(1, 6))),
        lines("", said("Highest score: ", number(F.col("high"), 2)), said("Lowest score: ", number(F.col("low"), 2)), "", "Average dimension scores:"), F.coalesce("dims", F.array().cast("array<string>")),
    )
    text = F.concat(begin, F.when(F.coalesce("valid", F.lit(0)) == 0, lines("No valid scores available")).otherwise(whole))
    head = _head(scores, [RULE, "CLIP Model Evaluation Summary Report", RULE, ""]).select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("model"), "line", "text")
    return head.unionByName(rows.select(F.lit(1).alias("part"), "model", F.posexplode(text).alias("line", "text")))


def _head(of: DataFrame, texts: list[str]) -> DataFrame:
    return of.sparkSession.createDataFrame(list(enumerate(texts)), "line int, text string")


def model_comparison(images: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """Rank (0: head and ranking), sentence_idx (-1: of the whole model), line, text, ordered by these, from rows of model, sentence_idx, sentence, image_idx and scores.

    Sentences are counted out of their own number of images. Null sentences are
    said as None.
    """
    keys = ["model", "sentence_idx"]
    ranked = ops.ranked(ops.model_statistics(images, p))
    names = [("avg_composite_score", 12, 2), ("avg_hard_score", 10, 2), ("avg_soft_score", 10, 2), ("avg_consistency_cv", 15, 4)]
    row = said(padded(F.col("rank").cast("string"), 6), padded(F.col("model"), 15), *(padded(number(F.col(c), d), w) for c, w, d in names), padded(percent(F.col("sentence_pass_rate")), 10))
    threshold = f"{p.pass_threshold:g}" if p.pass_threshold != int(p.pass_threshold) else f"{p.pass_threshold:.1f}"
    titles = "".join(t.ljust(w) for t, w in (("Rank", 6), ("Model", 15), ("Composite Score", 12), ("Hard Score", 10), ("Soft Score", 10), ("Consistency (CV)", 15), ("Pass Rate", 10)))
    head = [
        RULE, "Composite Scoring System - Model Comparison Report", RULE, "", "Scoring Formula:", "  Score_final = α × S_hard + (1-α) × S_soft", f"  Where α = {p.alpha} (weight for hard metrics)", "", "Consistency Metrics:",
        "  A. Coefficient of Variation: Consistency = max(0, 1 - σ/μ)", f"  B. Pass Rate: All 3 images must have scores ≥ {threshold} to pass", "", RULE, "Model Composite Score Ranking", RULE, "", titles, THIN,
    ]
    whole = lambda: (F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("sentence_idx"))
    out = _head(images, head).select(*whole(), "line", "text")
    out = out.unionByName(ranked.select(*whole(), (F.col("rank") + len(head) - 1).alias("line"), row.alias("text")))
    mean = lambda label, c, end="": said(f"  {label}: ", number(F.col(f"avg_{c}_score"), 2), " ± ", number(F.col(f"std_{c}_score"), 2), end)
    about = lines(
        "", "", RULE, said("Model: ", F.col("model")), RULE, "", "Overall Statistics:", SHORT, said("  Total Sentences: ", F.col("total_sentences")), said("  Total Images: ", F.col("total_images")), "",
        "Average Scores:", mean("Overall score", "composite"), mean("Hard Score", "hard", " "), mean("Soft Score", "soft", " "), "",
        "Consistency indicators:", said("  Average Consistency (CV): ", number(F.col("avg_consistency_cv"), 4)), said("  Sentences Passed: ", F.col("sentence_pass_count"), "/", F.col("total_sentences")), said("  Pass Rate: ", percent(F.col("sentence_pass_rate"))), "",
        "Detailed Scores for Each Sentence:", SHORT,
    )
    out = out.unionByName(ranked.select("rank", F.lit(-1).cast("long").alias("sentence_idx"), F.posexplode(about).alias("line", "text")))

    sentences = ops.consistency(images, keys).join(ops.pass_rate(images, keys, p), keys).join(images.groupBy(*keys).agg(F.min("sentence").alias("sentence"), F.count("*").alias("n")), keys).join(ranked.select("model", "rank"), "model")
    state = F.when(F.col("all_pass"), "✓ Passed").otherwise("✗ Failed")
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("line"), F.lit("").alias("text")),
        F.struct(F.lit(1).cast("long").alias("line"), said("Sentence ", F.col("sentence_idx"), ": ", F.coalesce("sentence", F.lit("None"))).alias("text")),
        F.struct((F.col("n") + 2).alias("line"), said("  Consistency: CV=", number(F.col("consistency"), 4), " (μ=", number(F.col("mean"), 2), ", σ=", number(F.col("std"), 2), ")").alias("text")),
        F.struct((F.col("n") + 3).alias("line"), said("  Pass Status: ", state, " (Min Score=", number(F.col("min_score"), 2), ", Pass Count=", F.col("pass_count"), "/3)").alias("text")),
    )
    told = sentences.select("rank", F.col("sentence_idx").cast("long").alias("sentence_idx"), F.inline(ends))
    one = said("  Image ", F.col("image_idx"), ": Composite=", number(F.col("score_final_scaled"), 2), ", Hard=", number(F.col("hard_score"), 1), ", Soft=", number(F.col("soft_score"), 1))
    each = images.join(ranked.select("model", "rank"), "model").select("rank", F.col("sentence_idx").cast("long").alias("sentence_idx"), (F.col("image_idx") + 1).cast("long").alias("line"), one.alias("text"))
    return out.select("rank", "sentence_idx", F.col("line").cast("long").alias("line"), "text").unionByName(told).unionByName(each)


def level_report(contact: DataFrame, levels: DataFrame, names: dict[str, str]) -> DataFrame:
    """Part (0: head, 1: comparison, 2: models), model, line, text, ordered by these. contact: contact_statistics; levels: per_level_accuracy."""
    by_level = levels.groupBy("model").pivot("level", list(names)).agg(F.first("accuracy"))
    rows = contact.join(by_level, "model")
    titles = "".join(t.ljust(w) for t, w in (("Model", 20), ("L1 Contact", 15), ("Level Acc", 15), *((f"{x} Acc", 12) for x in names)))
    head = [RULE, "Fuzzy Term Level-based Analysis Report", RULE, "", "Level Definitions:", THIN, *(f"  {x}: {n}" for x, n in names.items()), "", RULE, "Model Comparison", RULE, "", titles, THIN]
    table = said(padded(F.col("model"), 20), *(padded(percent(F.col(c)), w) for c, w in (("l1_accuracy", 15), ("accuracy", 15), *((x, 12) for x in names))))
    about = lines(
        "", "", RULE, said("Detailed Analysis: ", F.col("model")), RULE, "", "Contact Detection (L1 Specific):", SHORT, said("  Total L1 images: ", F.col("l1_total")), said("  Correctly detected: ", F.col("l1_correct")), said("  Accuracy: ", percent(F.col("l1_accuracy"))), "",
        "Level Prediction:", SHORT, said("  Total predictions: ", F.col("total")), said("  Correct predictions: ", F.col("correct")), said("  Overall accuracy: ", percent(F.col("accuracy"))), "",
        "Per-Level Accuracy:", *(said(f"  {x} ({n}): ", percent(F.col(x))) for x, n in names.items()),
    )
    out = _head(contact, head).select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("model"), "line", "text")
    out = out.unionByName(rows.select(F.lit(1).alias("part"), "model", F.lit(0).alias("line"), table.alias("text")))
    return out.unionByName(rows.select(F.lit(2).alias("part"), "model", F.posexplode(about).alias("line", "text")))
