"""Queries on scores: composite, consistency, statistics, ranking, soft scores, levels, reports."""

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..functions.lexicons import LEVELS, PROMPT_WEIGHTS
from ..operators import reports
from ..operators import scores as ops
from ..params import ScoreParams, TrainParams
from . import views as v
from .registry import register
from .views import half_up as R

P = ScoreParams()


def hard(spark, d):
    rows = v.evaluation(spark, d)
    return rows.select("model", "sentence_idx", "image_idx", "image_id", sc.hard_score(*(F.col(c) for c in sc.HARD)).alias("hard_score"))


def soft(spark, d):
    return v.evaluation(spark, d).select("model", "sentence_idx", "image_idx", sc.soft_score(F.col("clip_score")).alias("soft_score"))


def images(spark, d):
    """Both scores of an image and the composite. Both come from one scan here; F07 joins two results by position."""
    rows = v.evaluation(spark, d).select("model", "sentence_idx", "image_idx", "image_id", sc.hard_score(*(F.col(c) for c in sc.HARD)).alias("hard_score"), sc.soft_score(F.col("clip_score")).alias("soft_score"))
    return ops.scored(rows, P)


@register("G08", "SELECT image_id, hard_score FROM v_scored", "v_scored")
def g08(spark, d):
    return hard(spark, d).select("image_id", "hard_score")


@register("G09", "SELECT image_id, coalesce(clip_score, 0e0) AS soft_score FROM v_eval", "v_eval")
def g09(spark, d):
    return v.evaluation(spark, d).select("image_id", sc.soft_score(F.col("clip_score")).alias("soft_score"))


@register("G10", "SELECT image_id, s_hard_normalized, s_soft_normalized, score_final, score_final_scaled FROM v_composite", "v_composite")
def g10(spark, d):
    return images(spark, d).select("image_id", "s_hard_normalized", "s_soft_normalized", "score_final", "score_final_scaled")


@register("F07", "SELECT model, sentence_idx, image_idx, hard_score, soft_score FROM v_scored", "v_scored")
def f07(spark, d):
    return ops.paired(hard(spark, d).drop("image_id"), soft(spark, d))


# The hard results lack one model and have no images of another; the soft ones lack a third.
LISTS = """hard AS (SELECT model, count(image_id) FILTER (model <> '3-MEDIUM') AS n FROM v_eval WHERE model <> '5-LOW' GROUP BY model), soft AS (SELECT model, count(image_id) AS n FROM v_eval WHERE model <> '1-URGENT' GROUP BY model)"""


def result_lists(spark, d):
    """Model and number of images in the hard and in the soft results."""
    rows = v.evaluation(spark, d).select("model", "image_id")
    hard_n = rows.filter("model <> '5-LOW'").groupBy("model").agg(F.count(F.when(F.col("model") != "3-MEDIUM", F.col("image_id"))).alias("n"))
    return hard_n, rows.filter("model <> '1-URGENT'").groupBy("model").agg(F.count("image_id").alias("n"))


@register("F08", f"WITH {LISTS} SELECT model FROM hard JOIN soft USING (model)", "v_eval")
def f08(spark, d):
    a, b = result_lists(spark, d)
    return a.select("model").join(b.select("model"), "model")


@register("U03", f"WITH {LISTS} SELECT model FROM hard INTERSECT SELECT model FROM soft", "v_eval")
def u03(spark, d):
    a, b = result_lists(spark, d)
    return a.select("model").intersect(b.select("model"))


@register("P08", f"WITH {LISTS} SELECT model, hard.n AS hard_images, soft.n AS soft_images FROM hard JOIN soft USING (model) WHERE hard.n > 0 AND soft.n > 0", "v_eval")
def p08(spark, d):
    """Models with images in both results."""
    a, b = result_lists(spark, d)
    return a.withColumnRenamed("n", "hard_images").join(b.withColumnRenamed("n", "soft_images"), "model").filter("hard_images > 0 AND soft_images > 0")


CONSISTENCY = f"""cons AS (SELECT model, sentence_idx, avg(score_final_scaled) AS m, coalesce(stddev_samp(score_final_scaled), 0e0) AS s FROM v_composite GROUP BY model, sentence_idx),
cv AS (SELECT model, sentence_idx, {R("m", 4)} AS mean, {R("s", 4)} AS std, {R("CASE WHEN m = 0 THEN 0 ELSE s / m END", 4)} AS cv, {R("CASE WHEN m = 0 THEN 0 ELSE greatest(0, 1 - s / m) END", 4)} AS consistency FROM cons)"""
PASS = f"""ok AS (SELECT model, sentence_idx, {R("min(score_final_scaled)", 2)} AS min_score, bool_and(score_final_scaled >= 10) AS all_pass, count(*) FILTER (score_final_scaled >= 10) AS pass_count,
 {R("count(*) FILTER (score_final_scaled >= 10) / count(*)", 4)} AS pass_rate FROM v_composite GROUP BY model, sentence_idx)"""
STATS = f"""{CONSISTENCY}, {PASS}, sent AS (SELECT model, count(*) AS total_sentences, {R("avg(consistency)", 4)} AS avg_consistency_cv, count(*) FILTER (all_pass) AS sentence_pass_count FROM cv JOIN ok USING (model, sentence_idx) GROUP BY model),
img AS (SELECT model, count(*) AS total_images, {R("avg(score_final_scaled)", 2)} AS avg_composite_score, {R("stddev_pop(score_final_scaled)", 2)} AS std_composite_score, {R("avg(hard_score)", 2)} AS avg_hard_score,
 {R("stddev_pop(hard_score)", 2)} AS std_hard_score, {R("avg(soft_score)", 2)} AS avg_soft_score, {R("stddev_pop(soft_score)", 2)} AS std_soft_score FROM v_composite GROUP BY model),
stats AS (SELECT *, {R("sentence_pass_count / total_sentences", 4)} AS sentence_pass_rate FROM img JOIN sent USING (model))"""


@register("A01", f"WITH {CONSISTENCY} SELECT * FROM cv", "v_composite")
def a01(spark, d):
    return ops.consistency(images(spark, d), ["model", "sentence_idx"])


@register("A02", f"WITH {PASS} SELECT * FROM ok", "v_composite")
def a02(spark, d):
    return ops.pass_rate(images(spark, d), ["model", "sentence_idx"], P)


@register("A03", f"WITH {STATS} SELECT * FROM stats", "v_composite")
def a03(spark, d):
    return ops.model_statistics(images(spark, d), P)


@register("W03", f"WITH {STATS} SELECT *, CAST(row_number() OVER (ORDER BY avg_composite_score DESC, model) AS INTEGER) AS rank FROM stats", "v_composite")
def w03(spark, d):
    return ops.ranked(ops.model_statistics(images(spark, d), P))


@register("A16", "SELECT model, round(quantile_cont(score_final_scaled, 0.25), 6) AS q1, round(quantile_cont(score_final_scaled, 0.5), 6) AS median, round(quantile_cont(score_final_scaled, 0.75), 6) AS q3, round(avg(score_final_scaled), 6) AS mean FROM v_composite GROUP BY model", "v_composite")
def a16(spark, d):
    return ops.box_plot(images(spark, d))


@register("W18", "SELECT model, max(score_final_scaled) AS highest, min(score_final_scaled) AS lowest FROM v_composite GROUP BY model", "v_composite")
def w18(spark, d):
    return images(spark, d).groupBy("model").agg(F.max("score_final_scaled").alias("highest"), F.min("score_final_scaled").alias("lowest"))


@register("A20", "SELECT model, sentence_idx, count(*) AS n, string_agg(image_idx, ',' ORDER BY image_idx) AS order_of_images FROM v_composite GROUP BY model, sentence_idx", "v_composite")
def a20(spark, d):
    """Nested results: images in order within a sentence."""
    nested = images(spark, d).groupBy("model", "sentence_idx").agg(F.sort_array(F.collect_list(F.struct("image_idx", "hard_score", "soft_score", "score_final_scaled"))).alias("images"))
    return nested.select("model", "sentence_idx", F.size("images").cast("long").alias("n"), F.array_join(F.transform("images", lambda i: i["image_idx"].cast("string")), ",").alias("order_of_images"))


@register("K11", f"""SELECT model, sentence_idx, '{{"model_name":"' || model || '","alpha":0.6,"sentence_idx":' || sentence_idx || ',"images":[' || string_agg('{{"image_idx":' || image_idx || ',"hard_score":' || hard_score || ',"soft_score":' || soft_score || ',"score_final_scaled":' || score_final_scaled || '}}', ',' ORDER BY image_idx) || ']}}' AS json FROM v_composite GROUP BY model, sentence_idx""", "v_composite")
def k11(spark, d):
    """Composite results, one JSON document per model and sentence: a document holds a sentence's images, not a whole model."""
    nested = images(spark, d).groupBy("model", "sentence_idx").agg(F.sort_array(F.collect_list(F.struct("image_idx", "hard_score", "soft_score", "score_final_scaled"))).alias("images"))
    return nested.select("model", "sentence_idx", F.to_json(F.struct(F.col("model").alias("model_name"), F.lit(P.alpha).alias("alpha"), "sentence_idx", "images")).alias("json"))


PAD = lambda c, n: f"rpad({c}, CAST(greatest(length({c}), {n}) AS INT), ' ')"
FIX = lambda c, n: f"printf('%.{n}f', {R(c, n)})"
EQ, DASH, SHORT = "repeat('=', 80)", "repeat('-', 80)", "repeat('-', 40)"
LONG = "'composite-model-with-a-name-of-forty-characters-' || model"
TITLES = "Rank  Model          Composite ScoreHard ScoreSoft ScoreConsistency (CV)Pass Rate "
OVER = lambda label, c, end="": f"'  {label}: ' || {FIX(f'avg_{c}_score', 2)} || ' ± ' || {FIX(f'std_{c}_score', 2)} || '{end}'"


@register("K12", f"""WITH {STATS}, r AS (SELECT * REPLACE ({LONG} AS model), CAST(row_number() OVER (ORDER BY avg_composite_score DESC, model) AS INTEGER) AS rank, {FIX("100 * sentence_pass_rate", 2)} || '%' AS pass FROM stats),
head AS (SELECT [{EQ}, 'Composite Scoring System - Model Comparison Report', {EQ}, '', 'Scoring Formula:', '  Score_final = α × S_hard + (1-α) × S_soft', '  Where α = 0.6 (weight for hard metrics)', '', 'Consistency Metrics:', '  A. Coefficient of Variation: Consistency = max(0, 1 - σ/μ)', '  B. Pass Rate: All 3 images must have scores ≥ 10.0 to pass', '', {EQ}, 'Model Composite Score Ranking', {EQ}, '', '{TITLES}', {DASH}] AS texts),
about AS (SELECT rank, ['', '', {EQ}, 'Model: ' || model, {EQ}, '', 'Overall Statistics:', {SHORT}, '  Total Sentences: ' || total_sentences, '  Total Images: ' || total_images, '', 'Average Scores:', {OVER("Overall score", "composite")}, {OVER("Hard Score", "hard", " ")}, {OVER("Soft Score", "soft", " ")}, '',
 'Consistency indicators:', '  Average Consistency (CV): ' || {FIX("avg_consistency_cv", 4)}, '  Sentences Passed: ' || sentence_pass_count || '/' || total_sentences, '  Pass Rate: ' || pass, '', 'Detailed Scores for Each Sentence:', {SHORT}] AS texts FROM r),
n AS (SELECT model, sentence_idx, count(*) AS n FROM v_composite GROUP BY ALL),
sen AS (SELECT rank, cv.sentence_idx, n, ['', 'Sentence ' || cv.sentence_idx || ': ' || CASE WHEN cv.sentence_idx % 9 = 0 THEN 'None' ELSE 'scene ' || cv.sentence_idx END, '  Consistency: CV=' || {FIX("consistency", 4)} || ' (μ=' || {FIX("mean", 2)} || ', σ=' || {FIX("std", 2)} || ')', '  Pass Status: ' || CASE WHEN all_pass THEN '✓ Passed' ELSE '✗ Failed' END || ' (Min Score=' || {FIX("min_score", 2)} || ', Pass Count=' || pass_count || '/3)'] AS texts
 FROM cv JOIN ok ON cv.model = ok.model AND cv.sentence_idx = ok.sentence_idx JOIN n ON n.model = cv.model AND n.sentence_idx = cv.sentence_idx JOIN r ON r.model = 'composite-model-with-a-name-of-forty-characters-' || cv.model)
SELECT 0 AS rank, CAST(-1 AS BIGINT) AS sentence_idx, CAST(generate_subscripts(texts, 1) - 1 AS BIGINT) AS line, unnest(texts) AS text FROM head
UNION ALL SELECT 0, -1, rank + 17, {PAD("CAST(rank AS VARCHAR)", 6)} || {PAD("model", 15)} || {PAD(FIX("avg_composite_score", 2), 12)} || {PAD(FIX("avg_hard_score", 2), 10)} || {PAD(FIX("avg_soft_score", 2), 10)} || {PAD(FIX("avg_consistency_cv", 4), 15)} || {PAD("pass", 10)} FROM r
UNION ALL SELECT rank, -1, generate_subscripts(texts, 1) - 1, unnest(texts) FROM about
UNION ALL SELECT rank, sentence_idx, CASE WHEN i <= 2 THEN i - 1 ELSE n + i - 1 END, texts[i] FROM sen, range(1, 5) t(i)
UNION ALL SELECT rank, sentence_idx, image_idx + 1, '  Image ' || image_idx || ': Composite=' || {FIX("score_final_scaled", 2)} || ', Hard=' || {FIX("hard_score", 1)} || ', Soft=' || {FIX("soft_score", 1)} FROM v_composite c JOIN r ON r.model = 'composite-model-with-a-name-of-forty-characters-' || c.model""", "v_composite")
def k12(spark, d):
    """The whole comparison of models, of long names; every ninth sentence is missing."""
    sentence = F.when(F.col("sentence_idx") % 9 != 0, F.concat(F.lit("scene "), F.col("sentence_idx").cast("string")))
    rows = images(spark, d).withColumn("sentence", sentence).withColumn("model", F.concat(F.lit("composite-model-with-a-name-of-forty-characters-"), "model"))
    return reports.model_comparison(rows, P)


@register("K15", " UNION ALL ".join(f"SELECT model, '{n}' AS series, {R(f'avg({c})', 2)} AS value FROM v_composite GROUP BY model" for n, c in (("composite", "score_final_scaled"), ("hard", "hard_score"), ("soft", "soft_score"))), "v_composite")
def k15(spark, d):
    """Data of the grouped bar chart; drawing is left to the reader."""
    s = images(spark, d).groupBy("model").agg(*(sc.rounded(F.avg(c), 2).alias(n) for n, c in (("composite", "score_final_scaled"), ("hard", "hard_score"), ("soft", "soft_score"))))
    return s.unpivot("model", ["composite", "hard", "soft"], "series", "value")


# Soft scores.
SOFT = "soft AS (SELECT model, image_id, error, CASE WHEN error IS NULL THEN coalesce(clip_score, 0e0) ELSE 0e0 END AS clip_score FROM v_eval), ok AS (SELECT * FROM soft WHERE error IS NULL)"


def soft_rows(spark, d):
    return v.evaluation(spark, d).select("model", "image_id", "error", F.when(F.col("error").isNotNull(), 0.0).otherwise(sc.soft_score(F.col("clip_score"))).alias("clip_score"))


@register("P09", f"WITH {SOFT} SELECT image_id, error IS NULL AS valid FROM soft", "v_eval")
def p09(spark, d):
    return soft_rows(spark, d).select("image_id", F.col("error").isNull().alias("valid"))


@register("A11", f"WITH {SOFT} SELECT model, (SELECT count(*) FROM soft s WHERE s.model = ok.model) AS total_images, count(*) AS valid, (SELECT count(error) FROM soft s WHERE s.model = ok.model) AS errors, round(avg(clip_score), 4) AS average, round(stddev_pop(clip_score), 4) AS deviation, max(clip_score) AS highest, min(clip_score) AS lowest FROM ok GROUP BY model", "v_eval")
def a11(spark, d):
    return ops.score_summary(soft_rows(spark, d))


@register("A10", f"WITH {SOFT}, m AS (SELECT model, count(*) AS n FROM ok GROUP BY model) SELECT m.model, CAST(b AS INTEGER) AS bin, count(ok.image_id) AS count, round(100e0 * count(ok.image_id) / n, 4) AS percentage FROM m CROSS JOIN range(1, 6) t(b) LEFT JOIN ok ON ok.model = m.model AND clip_score >= b AND clip_score < b + 1 GROUP BY m.model, b, n", "v_eval")
def a10(spark, d):
    return ops.score_histogram(soft_rows(spark, d))


@register("T30", f"WITH {SOFT} SELECT image_id, repeat('█', CAST(floor(clip_score * 20 / 2) AS INT)) AS bar FROM soft", "v_eval")
def t30(spark, d):
    return soft_rows(spark, d).select("image_id", tx.bar(F.col("clip_score") * 20).alias("bar"))


PROBS = """p AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM v_clip), q AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS pr FROM p)"""
WEIGHTS = (PROMPT_WEIGHTS["full_match"], PROMPT_WEIGHTS["objects"], PROMPT_WEIGHTS["scene"])


def with_probabilities(spark, d):
    return v.clip(spark, d).withColumn("pr", sc.softmax(F.col("logits")))


def clip_scores(spark, d):
    """Score rows with a map of dimensions; every 13th image failed."""
    w = sc.weighted(F.col("pr"), F.array(*(F.lit(x) for x in WEIGHTS)))
    rows = with_probabilities(spark, d).withColumn("error", F.when(F.col("image_id") % 13 == 0, "no image")).withColumn("weighted_average", F.when(F.col("error").isNotNull(), 0.0).otherwise(w))
    dims = F.create_map(F.lit("full_match"), F.col("pr")[0], F.lit("objects"), F.col("pr")[1], F.lit("scene"), F.col("pr")[2])
    empty = F.create_map().cast("map<string,double>")
    return rows.select(F.concat(F.lit("model_"), F.col("label").cast("string")).alias("model"), "image_id", "error", "weighted_average", sc.soft_final(F.col("weighted_average"), F.col("error")).alias("clip_score"), F.when(F.col("error").isNull(), dims).otherwise(empty).alias("dimension_scores"))


CLIP = f"""{PROBS}, w AS (SELECT *, CASE WHEN image_id % 13 = 0 THEN 'no image' END AS error, CASE WHEN image_id % 13 = 0 THEN 0e0 ELSE pr[1] * 0.4e0 + pr[2] * 0.25e0 + pr[3] * 0.1e0 END AS weighted_average FROM q),
c AS (SELECT *, 'model_' || label AS model, CASE WHEN error IS NOT NULL THEN 0e0 ELSE 1 + 4 * weighted_average END AS clip_score FROM w)"""


@register("G11", f"WITH {CLIP} SELECT image_id, round(weighted_average, 6) AS weighted_average, round(clip_score, 6) AS clip_score FROM c WHERE error IS NULL", "v_clip")
def g11(spark, d):
    return clip_scores(spark, d).filter("error IS NULL").select("image_id", F.round("weighted_average", 6).alias("weighted_average"), F.round("clip_score", 6).alias("clip_score"))


@register("G13", f"WITH {CLIP} SELECT image_id, clip_score, weighted_average, 0 AS dimensions, error FROM c WHERE error IS NOT NULL", "v_clip")
def g13(spark, d):
    return clip_scores(spark, d).filter("error IS NOT NULL").select("image_id", "clip_score", "weighted_average", F.size("dimension_scores").alias("dimensions"), "error")


@register("A12", f"WITH {CLIP} SELECT model, 'full_match' AS dimension, round(avg(pr[1]), 6) AS average FROM c WHERE error IS NULL GROUP BY model UNION ALL SELECT model, 'objects', round(avg(pr[2]), 6) FROM c WHERE error IS NULL GROUP BY model UNION ALL SELECT model, 'scene', round(avg(pr[3]), 6) FROM c WHERE error IS NULL GROUP BY model", "v_clip")
def a12(spark, d):
    return ops.dimension_averages(clip_scores(spark, d))


@register("G12", f"WITH {PROBS} SELECT image_id, 'L' || list_position(pr, list_max(pr)) AS predicted_level, round(list_max(pr), 4) AS confidence FROM q", "v_clip")
def g12(spark, d):
    best = sc.best_level(F.col("pr"), F.array(*(F.lit(x) for x in LEVELS)))
    return with_probabilities(spark, d).select("image_id", best.alias("b")).select("image_id", "b.predicted_level", "b.confidence")


@register("M14", "SELECT image_id, logits[1] AS l0, logits[2] AS l1, logits[3] AS l2 FROM v_clip", "v_clip")
def m14(spark, d):
    return v.clip(spark, d).select("image_id", *(F.col("logits")[i].alias(f"l{i}") for i in range(3)))


@register("F15", "SELECT image_id, CAST(i - 1 AS INTEGER) AS prompt, logits[i] AS logit FROM v_clip, range(1, 4) t(i)", "v_clip")
def f15(spark, d):
    """Each image with each of its prompts."""
    return v.clip(spark, d).select("image_id", F.posexplode("logits").alias("prompt", "logit"))


@register("T22", f"""WITH {CLIP} SELECT image_id, CASE WHEN clip_score >= 4.5 THEN 'The image highly matches the description.' WHEN clip_score >= 3.5 THEN 'The image matches the description well.' WHEN clip_score >= 2.5 THEN 'The image partially matches the description.' ELSE 'The image matches the description poorly.' END
 || CASE WHEN error IS NOT NULL THEN '' ELSE ' Full description match is ' || CASE WHEN pr[1] > 0.7 THEN 'high' WHEN pr[1] > 0.5 THEN 'moderate' ELSE 'low' END || printf(' (%.2f).', round(pr[1], 2))
 || CASE WHEN pr[2] > 0.7 THEN ' Objects are accurately recognized, cup and dog are clearly visible.' WHEN pr[2] > 0.5 THEN ' Object recognition is generally accurate but may not be clear.' ELSE ' Object recognition has issues.' END
 || ' Scene ''room'' is ' || CASE WHEN pr[3] > 0.7 THEN 'highly' WHEN pr[3] > 0.5 THEN 'moderately' ELSE 'poorly' END || ' matched.' END AS reasoning FROM c""", "v_clip")
def t22(spark, d):
    text = tx.reasoning(F.col("clip_score"), F.col("dimension_scores"), F.array(F.lit("cup"), F.lit("dog")), F.lit("near"), F.lit("room"))
    return clip_scores(spark, d).select("image_id", text.alias("reasoning"))


# Terms and levels.
@register("T23", "SELECT sentence_idx, coalesce(level, 'Unknown') AS level FROM v_terms LEFT JOIN v_map ON trim(lower(term)) = key", "v_terms", "v_map")
def t23(spark, d):
    return leveled(spark, d).select("sentence_idx", "level")


def leveled(spark, d):
    """the mapping is joined, so it may be large; Spark broadcasts it where its size allows."""
    t = v.terms(spark, d).withColumn("key", tx.fuzzy_key(F.col("term")))
    return t.join(v.mapping(spark, d), "key", "left").withColumn("level", F.coalesce("level", F.lit("Unknown")))


@register("F11", "SELECT sentence_idx, term, coalesce(level, 'Unknown') AS level FROM v_terms LEFT JOIN v_map ON trim(lower(term)) = key", "v_terms", "v_map")
def f11(spark, d):
    return leveled(spark, d).select("sentence_idx", "term", "level")


@register("P07", "SELECT sentence_idx, level FROM v_terms JOIN v_map ON trim(lower(term)) = key WHERE term <> ''", "v_terms", "v_map")
def p07(spark, d):
    return leveled(spark, d).filter("term <> '' AND level <> 'Unknown'").select("sentence_idx", "level")


@register("A08", "SELECT level, count(*) AS terms FROM v_map GROUP BY level", "v_map")
def a08(spark, d):
    return v.mapping(spark, d).groupBy("level").agg(F.count("*").alias("terms"))


@register("F09", "SELECT sentence_idx, image_id, term FROM v_terms JOIN v_eval USING (sentence_idx)", "v_terms", "v_eval")
def f09(spark, d):
    return v.terms(spark, d).join(v.evaluation(spark, d).select("sentence_idx", "image_id"), "sentence_idx").select("sentence_idx", "image_id", "term")


@register("T21", """SELECT sentence_idx, 'full_match' AS type, p_name AS text, 0.4e0 AS weight FROM v_terms JOIN part ON p_partkey = sentence_idx
 UNION ALL SELECT sentence_idx, 'objects', 'An image showing ' || split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2), 0.25e0 FROM v_terms JOIN part ON p_partkey = sentence_idx
 UNION ALL SELECT sentence_idx, 'spatial_relation', split_part(p_name, ' ', 1) || ' ' || term || ' ' || split_part(p_name, ' ', 2), 0.25e0 FROM v_terms JOIN part ON p_partkey = sentence_idx WHERE term <> ''
 UNION ALL SELECT sentence_idx, 'scene', 'A ' || p_type || ' scene with ' || split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2), 0.1e0 FROM v_terms JOIN part ON p_partkey = sentence_idx""", "v_terms")
def t21(spark, d):
    rows = v.terms(spark, d).join(v.table(spark, d, "part"), F.col("sentence_idx") == F.col("p_partkey"))
    prompts = tx.evaluation_prompts(F.col("p_name"), F.col("p_type"), F.split("p_name", " "), F.col("term"))
    return rows.select("sentence_idx", F.explode(prompts).alias("p")).select("sentence_idx", "p.*")


@register("T34", "SELECT p_partkey, split_part(p_name, ' ', 1) || ' touching ' || split_part(p_name, ' ', 2) AS l1, split_part(p_name, ' ', 1) || ' very close to ' || split_part(p_name, ' ', 2) AS l2, split_part(p_name, ' ', 1) || ' some way from ' || split_part(p_name, ' ', 2) AS l3 FROM part")
def t34(spark, d):
    texts = tx.level_phrases(F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1)))
    return v.table(spark, d, "part").select("p_partkey", texts.alias("t")).select("p_partkey", *(F.col("t")[i].alias(f"l{i + 1}") for i in range(3)))


# Formulas of generation and training.
@register("G16", "SELECT model, sentence_idx, image_idx, -1 + sentence_idx * 100 + image_idx AS seed FROM v_eval", "v_eval")
def g16(spark, d):
    return v.evaluation(spark, d).select("model", "sentence_idx", "image_idx", (F.lit(-1) + F.col("sentence_idx") * 100 + F.col("image_idx")).alias("seed"))


@register("F14", "SELECT n_nationkey AS model, r_regionkey AS sentence, CAST(k AS INTEGER) AS image FROM nation, region, range(1, 4) t(k)")
def f14(spark, d):
    """Models by sentences by images: both lists are configuration, so their product is the work list itself."""
    models = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("model"))
    sentences = v.table(spark, d, "region").agg(F.collect_list("r_regionkey").alias("sentences"))
    return models.join(sentences).select("model", F.explode("sentences").alias("sentence")).withColumn("image", F.explode(F.sequence(F.lit(1), F.lit(3))))


@register("G17", "SELECT model, count(*) AS n, CAST(ceil(count(*) / 32.0) AS BIGINT) AS steps_per_epoch, CAST(ceil(15000 / ceil(count(*) / 32.0)) AS BIGINT) AS epochs FROM v_eval GROUP BY model", "v_eval")
def g17(spark, d):
    p = TrainParams()
    steps = F.ceil(F.col("n") / (p.batch * p.devices * p.accumulate))
    return v.evaluation(spark, d).groupBy("model").agg(F.count("*").alias("n")).withColumn("steps_per_epoch", steps).withColumn("epochs", F.ceil(F.lit(15000) / F.col("steps_per_epoch")))


@register("G18", "SELECT image_id, round(least(hard_score, 5e0) / nullif(hard_score, 0), 6) AS weight, round(least(hard_score, 5e0) / (hard_score + 1), 6) AS v_weight FROM v_scored", "v_scored")
def g18(spark, d):
    g = TrainParams().snr_gamma
    return hard(spark, d).select("image_id", F.round(sc.min_snr_weight(F.col("hard_score"), g), 6).alias("weight"), F.round(sc.min_snr_weight(F.col("hard_score"), g, v_prediction=True), 6).alias("v_weight"))


@register("A21", "SELECT sentence_idx, round(avg(hard_score), 6) AS loss FROM v_scored GROUP BY sentence_idx", "v_scored")
def a21(spark, d):
    return hard(spark, d).groupBy("sentence_idx").agg(F.round(F.avg("hard_score"), 6).alias("loss"))


@register("P03", f"WITH {PROBS} SELECT image_id FROM q WHERE list_position(pr, list_max(pr)) = 1 AND list_max(pr) > 0.5", "v_clip")
def p03(spark, d):
    """Zero-shot filter: the first label wins with more than one half."""
    best = sc.best_level(F.col("pr"), F.array(*(F.lit(x) for x in LEVELS)))
    rows = with_probabilities(spark, d).withColumn("b", best)
    return rows.filter((F.col("b.predicted_level") == "L1") & (F.array_max("pr") > 0.5)).select("image_id")


@register("K09", f"""WITH {CLIP} SELECT model, image_id, '{{"image_id":' || image_id || ',"clip_score":' || printf('%.3f', round(clip_score, 3)) || ',"dimension_scores":{{' || CASE WHEN error IS NULL THEN concat_ws(',', '"full_match":"' || printf('%.3f', round(pr[1], 3)) || '"', '"objects":"' || printf('%.3f', round(pr[2], 3)) || '"', '"scene":"' || printf('%.3f', round(pr[3], 3)) || '"') ELSE '' END || '}}' || coalesce(',"error":"' || error || '"', '') || '}}' AS json FROM c""", "v_clip")
def k09(spark, d):
    """Soft results, a JSON line for each image with scores to three places; a document of a model is its lines."""
    three = lambda c: F.format_string("%.3f", F.round(c, 3))
    rows = clip_scores(spark, d).withColumn("clip_score", three(F.col("clip_score")).cast("decimal(10, 3)"))
    image = F.struct("image_id", "clip_score", F.transform_values("dimension_scores", lambda _, x: three(x)).alias("dimension_scores"), "error")
    return rows.select("model", "image_id", F.to_json(image).alias("json"))


DIMS = ("full_match", "objects", "scene")
BAR = lambda b: f"'  {b}-{b + 1} points: ' || lpad(CAST(b{b} AS VARCHAR), CAST(greatest(3, length(CAST(b{b} AS VARCHAR))) AS INT), ' ') || ' (' || lpad({FIX(f'100e0 * b{b} / valid', 1)}, CAST(greatest(5, length({FIX(f'100e0 * b{b} / valid', 1)})) AS INT), ' ') || '%) ' || repeat('█', CAST(floor(100e0 * b{b} / valid / 2) AS INT))"


@register("K10", f"""WITH {CLIP}, e AS (SELECT 'soft-model-with-a-name-of-forty-characters-' || model AS model, clip_score, CASE WHEN model = 'model_0' THEN 'no image' ELSE error END AS error, pr FROM c),
s AS (SELECT model, count(*) AS total, count(error) AS errors, count(*) FILTER (error IS NULL) AS valid, avg(clip_score) FILTER (error IS NULL) AS a, stddev_pop(clip_score) FILTER (error IS NULL) AS sd, max(clip_score) FILTER (error IS NULL) AS hi, min(clip_score) FILTER (error IS NULL) AS lo,
 {", ".join(f"count(*) FILTER (error IS NULL AND clip_score >= {b} AND clip_score < {b + 1}) AS b{b}" for b in range(1, 6))}, {", ".join(f"avg(pr[{i}]) FILTER (error IS NULL) AS d{i}" for i in (1, 2, 3))} FROM e GROUP BY model),
l AS (SELECT 0 AS part, NULL AS model, [{EQ}, 'CLIP Model Evaluation Summary Report', {EQ}, ''] AS texts UNION ALL SELECT 1, model, list_concat(['', {EQ}, 'Model: ' || model, {DASH}], CASE WHEN valid = 0 THEN ['No valid scores available'] ELSE ['Total images: ' || total, 'Valid scores: ' || valid, 'Evaluation errors: ' || errors, 'Average score: ' || {FIX("a", 2)} || '/5.0', 'Standard deviation: ' || {FIX("sd", 2)}, '', 'Score distribution:', {", ".join(BAR(b) for b in range(1, 6))}, '', 'Highest score: ' || {FIX("hi", 2)}, 'Lowest score: ' || {FIX("lo", 2)}, '', 'Average dimension scores:', {", ".join(f"'  {n}: ' || {FIX(f'd{i + 1}', 4)}" for i, n in enumerate(DIMS))}] END) FROM s)
SELECT part, model, CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS line, unnest(texts) AS text FROM l""", "v_clip")
def k10(spark, d):
    """The whole soft summary, of long names; one model has no valid score."""
    rows = clip_scores(spark, d).withColumn("error", F.when(F.col("model") == "model_0", "no image").otherwise(F.col("error")))
    return reports.soft_summary(rows.withColumn("model", F.concat(F.lit("soft-model-with-a-name-of-forty-characters-"), "model")))
