"""Queries on what training loops compute: running averages of weights, checkpoints, gathered losses."""

from pyspark.sql import functions as F

from ..operators import training as ops
from . import views as v
from .registry import register

DECAY = "CASE WHEN n.step <= 1 THEN 0e0 ELSE least(0.9999e0, n.step / (n.step + 9e0)) END"
AVERAGES = f"""RECURSIVE n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s(label, step, v) AS (SELECT label, step, e FROM n WHERE step = 0
 UNION ALL SELECT n.label, n.step, list_transform(list_zip(s.v, n.e), lambda z: {DECAY} * z[1] + (1 - {DECAY}) * z[2]) FROM s JOIN n ON n.label = s.label AND n.step = s.step + 1)"""


@register("M16", f"""WITH {AVERAGES}, g AS (SELECT label, step, least(1e0, 1e0 / (sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-6)) AS scale FROM n)
SELECT label, step, CAST(i - 1 AS INTEGER) AS i, round(v[i], 6) AS average, round(scale, 6) AS clip FROM s JOIN g USING (label, step), (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i)""")
def m16(spark, d):
    """Embeddings of a label as a parameter's weights after each step: its running average, and how far its vector as a gradient would be clipped."""
    rows = v.table(spark, d, "embeddings")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    clips = ops.steps(rows.select("label", "vec_id", squares.alias("squares")), "label", "vec_id").select("label", "step", F.round(ops.clip_scale(F.col("squares"), 1.0), 6).alias("clip"))
    averages = ops.weight_averages(rows, "label", "vec_id", "embedding")
    return averages.join(clips, ["label", "step"]).select("label", "step", "i", F.round("value", 6).alias("average"), "clip")


@register("K17", f"WITH {AVERAGES} SELECT label, array_to_string(list_transform(v, lambda x: printf('%.5f', x)), ',') AS weights FROM s WHERE step = (SELECT max(t.step) FROM s t WHERE t.label = s.label)")
def k17(spark, d):
    """Averaged weights as a checkpoint holds them."""
    final = ops.final_weights(ops.weight_averages(v.table(spark, d, "embeddings"), "label", "vec_id", "embedding"), "label")
    return final.select("label", F.array_join(F.transform("weights", lambda x: F.format_string("%.5f", x)), ",").alias("weights"))


@register("A22", "SELECT micro // 4 AS step, round(sum(g) / 4, 9) AS loss FROM (SELECT l_orderkey AS micro, avg(l_discount) AS g FROM lineitem GROUP BY 1) GROUP BY 1")
def a22(spark, d):
    """Losses of the devices (lines) of a micro step (order), four of which make a step."""
    rows = v.table(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").cast("double").alias("loss"))
    return ops.gathered_loss(rows, "l_orderkey", "loss", 4).select("step", F.round("loss", 9).alias("loss"))
