"""Queries on boxes: geometry, thresholds, pairs, fusion, suppression, instance ids."""

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import boxes as ops
from ..params import DetectionParams
from . import views as v
from .registry import register
from .views import half_up as R

P = DetectionParams()
# Pairs of neighbours in an image, and their overlap and gap, for the oracle.
PAIR = """pair AS (SELECT a.image_id, a.box_id AS i, b.box_id AS j, a.core = b.core AS same_core, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h,
 (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab, greatest(0, a.x1 - b.x2 - 0e0, b.x1 - a.x2) AS dx, greatest(0, a.y1 - b.y2 - 0e0, b.y1 - a.y2) AS dy
 FROM {0} a JOIN {0} b ON a.image_id = b.image_id AND {1}),
geo AS (SELECT *, CASE WHEN w < 0 OR h < 0 OR aa + ab - w * h = 0 THEN 0e0 ELSE w * h / (aa + ab - w * h) END AS iou, sqrt(dx * dx + dy * dy) AS gap FROM pair)"""
# The second box moved right by 10 px for each box before it, so that gaps occur.
APART = "apart AS (SELECT image_id, box_id, core, x1 + 10 * box_id AS x1, y1, x2 + 10 * box_id AS x2, y2 FROM v_boxes)"


def box_col(prefix=""):
    return geo.box(*(F.col(prefix + s) for s in geo.SIDES))


def neighbours(spark, d):
    """Box i and the next box of its image, moved apart."""
    moved = v.boxes(spark, d).select("image_id", "box_id", F.struct((F.col("x1") + 10 * F.col("box_id")).alias("x1"), "y1", (F.col("x2") + 10 * F.col("box_id")).alias("x2"), "y2").alias("a"))
    nxt = W.Window.partitionBy("image_id").orderBy("box_id")
    return moved.withColumn("b", F.lead("a").over(nxt)).filter("b IS NOT NULL").select("image_id", F.col("box_id").alias("i"), "a", "b")


@register("G01", "SELECT image_id, box_id, round(x1 / 640, 9) AS x1, round(y1 / 480, 9) AS y1, round(x2 / 640, 9) AS x2, round(y2 / 480, 9) AS y2 FROM v_boxes", "v_boxes")
def g01(spark, d):
    b = geo.normalised(box_col(), F.lit(640.0), F.lit(480.0))
    return v.boxes(spark, d).select("image_id", "box_id", b.alias("b")).select("image_id", "box_id", *(F.round(f"b.{s}", 9).alias(s) for s in geo.SIDES))


@register("G02", "SELECT image_id, box_id, x1 * 640 AS x1, y1 * 480 AS y1, x2 * 640 AS x2, y2 * 480 AS y2 FROM v_boxes", "v_boxes")
def g02(spark, d):
    b = geo.scaled(box_col(), F.lit(640.0), F.lit(480.0))
    return v.boxes(spark, d).select("image_id", "box_id", b.alias("b")).select("image_id", "box_id", *(f"b.{s}" for s in geo.SIDES))


NEXT = f"{APART}, {PAIR.format('apart', 'b.box_id = a.box_id + 1')} "


@register("G03", f"WITH {NEXT} SELECT image_id, i, round(iou, 6) AS iou FROM geo", "v_boxes")
def g03(spark, d):
    return neighbours(spark, d).select("image_id", "i", F.round(geo.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@register("G04", f"WITH {NEXT} SELECT image_id, i, round(iou, 6) AS iou FROM geo", "v_boxes")
def g04(spark, d):
    return neighbours(spark, d).select("image_id", "i", F.round(geo.iou(F.col("a"), F.col("b"), only_positive=True), 6).alias("iou"))


@register("G05", f"WITH {NEXT} SELECT image_id, i, round(gap, 6) AS gap FROM geo", "v_boxes")
def g05(spark, d):
    return neighbours(spark, d).select("image_id", "i", F.round(geo.distance(F.col("a"), F.col("b")), 6).alias("gap"))


@register("G06", f"WITH {NEXT} SELECT image_id, i, iou > 0 OR gap < 5 AS contact FROM geo", "v_boxes")
def g06(spark, d):
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, d).select("image_id", "i", geo.contact(geo.iou(a, b), geo.distance(a, b)).alias("contact"))


def image_level(image):
    return F.when(image % 4 == 0, "L1").when(image % 4 == 1, "L2").when(image % 4 == 2, "L3").otherwise("Unknown")


LEVEL = "CASE image_id % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' WHEN 2 THEN 'L3' ELSE 'Unknown' END"
CHECKS = f"""{APART}, {PAIR.format('apart', 'a.box_id = 1 AND b.box_id = 2')},
img AS (SELECT image_id, {LEVEL} AS level, count(*) AS n FROM v_boxes GROUP BY image_id),
chk AS (SELECT img.image_id, level, level = 'L1' AS contact_expected, n >= 2 AND (iou > 0 OR gap < 5) AS contact_detected, CASE WHEN n >= 2 THEN round(iou, 4) ELSE 0e0 END AS iou,
 CASE WHEN n >= 2 THEN round(gap, 2) ELSE CAST('inf' AS DOUBLE) END AS pixel_distance, n >= 2 AND (level <> 'L1' OR iou > 0 OR gap < 5) AS pass_contact_check, n, iou AS o, gap AS g
 FROM img LEFT JOIN geo USING (image_id))"""
REASON = """CASE WHEN n < 2 THEN 'Less than 2 objects detected' WHEN level = 'L1' AND contact_detected AND o > 0 THEN printf('Contact detected via IoU=%.4f', o)
 WHEN level = 'L1' AND contact_detected THEN printf('Contact detected via pixel distance=%.2fpx', g) WHEN level = 'L1' THEN printf('L1 requires contact but IoU=%.4f, dist=%.2fpx', o, g)
 WHEN level = 'L2' AND o > 0 THEN printf('L2 should have IoU≈0 but got %.4f', o) WHEN level = 'L2' AND g < 10 THEN printf('L2 grazing/zero-gap: dist=%.2fpx', g) WHEN level = 'L2' THEN printf('Distance=%.2fpx', g)
 WHEN level = 'L3' AND g < 50 THEN printf('L3 proximity: dist=%.2fpx', g) WHEN level = 'L3' THEN printf('Distance=%.2fpx (may be too far for L3)', g) ELSE 'Unknown level' END"""


def contact_checks(spark, d):
    moved = v.boxes(spark, d).filter("box_id <= 2").select("image_id", "box_id", geo.box(F.col("x1") + 10 * F.col("box_id"), F.col("y1"), F.col("x2") + 10 * F.col("box_id"), F.col("y2")).alias("b"))
    lists = moved.groupBy("image_id").agg(F.min_by("b", "box_id").alias("a"), F.max_by("b", "box_id").alias("b"), F.count("*").alias("n"))
    gaps = lists.select("image_id", (F.col("n") >= 2).alias("two"), geo.iou(F.col("a"), F.col("b"), only_positive=True).alias("o"), geo.distance(F.col("a"), F.col("b")).alias("g"))
    check = geo.check_contact(F.col("two"), F.col("o"), F.col("g"), image_level(F.col("image_id")))
    return gaps.select("image_id", check.alias("c")).select("image_id", "c.*")


@register("G07", f"WITH {CHECKS} SELECT image_id, level, contact_expected, contact_detected, iou, pixel_distance, pass_contact_check FROM chk", "v_boxes")
def g07(spark, d):
    return contact_checks(spark, d).drop("reason")


@register("T24", f"WITH {CHECKS} SELECT image_id, {REASON} AS reason FROM chk", "v_boxes")
def t24(spark, d):
    return contact_checks(spark, d).select("image_id", "reason")


@register("G14", "SELECT image_id, box_id, score FROM v_boxes WHERE score > 0.36e0", "v_boxes")
def g14(spark, d):
    return ops.over_threshold(v.boxes(spark, d), P.score_threshold).select("image_id", "box_id", "score")


@register("G15", "SELECT image_id, box_id, CASE WHEN detector = 2 THEN 0.46e0 ELSE score END AS score FROM v_boxes WHERE detector = 2 OR score > 0.36e0", "v_boxes")
def g15(spark, d):
    unscored = F.col("detector") == 2
    rows = v.boxes(spark, d).filter(unscored | (F.col("score") > P.score_threshold))
    return rows.select("image_id", "box_id", F.when(unscored, F.round(F.lit(P.score_threshold + P.unscored_bonus), 2)).otherwise(F.col("score")).alias("score"))


@register("F03", "SELECT image_id, box_id, CASE WHEN core IN ('teddy', 'bear') THEN 'bear' ELSE core END AS standard FROM v_boxes", "v_boxes")
def f03(spark, d):
    from ..operators.keywords import once_each

    named = once_each(v.boxes(spark, d), "label", lambda labels: labels.withColumn("standard", tx.standard_label(F.col("label"))))
    return named.select("image_id", "box_id", "standard")


@register("F04", "SELECT image_id, box_id FROM v_boxes b WHERE EXISTS (SELECT 1 FROM v_boxes k WHERE k.image_id = b.image_id AND k.core = b.core AND k.detector = 0)", "v_boxes")
def f04(spark, d):
    boxes = v.boxes(spark, d)
    allowed = boxes.filter("detector = 0").select("image_id", "core").distinct()
    return boxes.join(allowed, ["image_id", "core"], "left_semi").select("image_id", "box_id")


@register("F05", """SELECT image_id, box_id FROM v_boxes b WHERE EXISTS (SELECT 1 FROM v_boxes k WHERE k.image_id = b.image_id AND k.detector = 0 AND (contains(lower(k.core), lower(b.label)) OR contains(lower(b.label), lower(k.core))))""", "v_boxes")
def f05(spark, d):
    boxes = v.boxes(spark, d)
    lists = boxes.filter("detector = 0").groupBy("image_id").agg(F.collect_set("core").alias("keywords"))
    return boxes.join(lists, "image_id").filter(F.exists("keywords", lambda k: tx.mutually_contained(F.col("label"), k))).select("image_id", "box_id")


@register("T31", "SELECT image_id, box_id, contains(lower(label), lower(core)) OR contains(lower(core), lower(label)) AS contained FROM v_boxes", "v_boxes")
def t31(spark, d):
    return v.boxes(spark, d).select("image_id", "box_id", tx.mutually_contained(F.col("label"), F.col("core")).alias("contained"))


@register("F06", f"WITH {PAIR.format('v_boxes', 'a.core = b.core AND a.box_id < b.box_id')} SELECT image_id, i, j, round(iou, 6) AS iou FROM geo WHERE iou > 0.85e0", "v_boxes")
def f06(spark, d):
    return ops.same_core_pairs(v.boxes(spark, d), ["image_id", "core"], "box_id", P.duplicate_iou).select("image_id", "i", "j", F.round("iou", 6).alias("iou"))


@register("A09", "SELECT image_id, core, count(*) AS instances FROM v_boxes GROUP BY image_id, core", "v_boxes")
def a09(spark, d):
    return v.boxes(spark, d).groupBy("image_id", "core").agg(F.count("*").alias("instances"))


_IOU = """CASE WHEN least({a}.x2, {b}.x2) < greatest({a}.x1, {b}.x1) OR least({a}.y2, {b}.y2) < greatest({a}.y1, {b}.y1) THEN 0e0 ELSE
 (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) /
 (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) END"""
# A scan in the order of score never removes by a later box: a box stays if it overlaps no box kept before it.
_W02 = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY image_id, core ORDER BY score DESC, box_id) AS k FROM v_boxes),
g AS (SELECT image_id, core, list({'k': k, 'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY k) AS m FROM o GROUP BY image_id, core),
f(image_id, core, m, step, kept) AS (SELECT image_id, core, m, 1, [m[1]] FROM g UNION ALL
 SELECT image_id, core, m, step + 1, CASE WHEN len(list_filter(kept, lambda q: """ + _IOU.format(a="q", b="m[step + 1]") + """ > 0.85e0)) = 0 THEN list_append(kept, m[step + 1]) ELSE kept END FROM f WHERE step < len(m))
SELECT image_id, core, unnest(list_transform(kept, lambda q: q.box_id)) AS box_id FROM f WHERE step = len(m)"""


@register("W02", _W02, "v_boxes")
def w02(spark, d):
    return ops.suppressed(v.boxes(spark, d), ["image_id", "core"], [(-F.col("score")).alias("k"), "box_id"], P.duplicate_iou)


@register("W01", "SELECT image_id, box_id, label || '_' || row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, box_id) AS instance_id FROM v_boxes", "v_boxes")
def w01(spark, d):
    return ops.with_instance_ids(v.boxes(spark, d), [F.desc("score"), "box_id"]).select("image_id", "box_id", "instance_id")


_SUMS = ", ".join(f"'s{c}': {{a}}.{c} * {{a}}.score" for c in ("x1", "y1", "x2", "y2"))
_FRESH = "{{'n': 1, 'total': {a}.score, 'x1': {a}.x1, 'y1': {a}.y1, 'x2': {a}.x2, 'y2': {a}.y2, " + _SUMS + "}}"
_GROWN = "{{'n': q.n + 1, 'total': q.total + {a}.score, " + ", ".join(f"'{c}': (q.s{c} + {{a}}.{c} * {{a}}.score) / (q.total + {{a}}.score)" for c in ("x1", "y1", "x2", "y2")) + ", " + ", ".join(f"'s{c}': q.s{c} + {{a}}.{c} * {{a}}.score" for c in ("x1", "y1", "x2", "y2")) + "}}"
# A box a step: its overlaps with the fused boxes, then the one that it overlaps most takes it, or it starts another.
_A15 = """WITH RECURSIVE b AS (SELECT * FROM v_boxes WHERE score > 0.36e0),
g AS (SELECT image_id, core, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score} ORDER BY score DESC, detector, box_id) AS m FROM b GROUP BY image_id, core),
f(image_id, core, m, step, kept) AS (SELECT image_id, core, m, 1, [""" + _FRESH.format(a="m[1]") + """] FROM g UNION ALL
 SELECT image_id, core, m, step + 1, CASE WHEN list_max(o) > 0.5e0 THEN list_transform(kept, lambda q, i: CASE WHEN i = list_position(o, list_max(o)) THEN """ + _GROWN.format(a="m[step + 1]") + """ ELSE q END) ELSE list_append(kept, """ + _FRESH.format(a="m[step + 1]") + """) END
 FROM (SELECT *, list_transform(kept, lambda q: """ + _IOU.format(a="q", b="m[step + 1]") + """) AS o FROM f WHERE step < len(m))),
r AS (SELECT image_id, core, unnest(kept) AS q, generate_subscripts(kept, 1) AS made FROM f WHERE step = len(m)),
s AS (SELECT *, q.total / q.n * least(CAST(q.n AS DOUBLE), 3e0) / 3e0 AS sc FROM r)
SELECT image_id, core AS label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY sc DESC, core, made) AS INTEGER) AS fused_rank, CAST(q.n AS INTEGER) AS members, round(sc, 6) AS score, round(q.x1, 6) AS x1, round(q.y1, 6) AS y1, round(q.x2, 6) AS x2, round(q.y2, 6) AS y2 FROM s"""


@register("A15", _A15, "v_boxes")
def a15(spark, d):
    out = ops.fused(ops.over_threshold(v.boxes(spark, d), P.score_threshold).withColumn("label", F.col("core")), P)
    return out.select("image_id", "label", "fused_rank", "members", *(F.round(c, 6).alias(c) for c in ("score", *geo.SIDES)))


@register("T10", "SELECT image_id, string_agg(label, ' . ' ORDER BY box_id) AS prompt FROM v_boxes GROUP BY image_id", "v_boxes")
def t10(spark, d):
    lists = v.boxes(spark, d).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("box_id", "label"))), lambda x: x["label"]).alias("labels"))
    return lists.select("image_id", tx.detector_prompt(F.col("labels")).alias("prompt"))


@register("T17", """SELECT image_id, string_agg(k || '. ' || label || ': location [' || printf('%.1f, %.1f, %.1f, %.1f', x1, y1, x2, y2) || ']', chr(10) ORDER BY k) AS lines FROM (SELECT *, box_id AS k FROM v_boxes) GROUP BY image_id""", "v_boxes")
def t17(spark, d):
    det = F.struct("box_id", F.col("label").alias("category"), F.array(*geo.SIDES).alias("location"), "score")
    lists = v.boxes(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(det)).alias("dets"))
    return lists.select("image_id", tx.object_lines(F.col("dets"), scores=False).alias("lines"))


@register("P05", "SELECT DISTINCT image_id FROM v_boxes WHERE score > 0.36e0", "v_boxes")
def p05(spark, d):
    lists = ops.over_threshold(v.boxes(spark, d), P.score_threshold).groupBy("image_id").agg(F.collect_list("box_id").alias("dets"))
    return lists.filter(F.size("dets") > 0).select("image_id")


@register("F01", "SELECT o_orderkey AS image_id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_sidecar FROM orders")
def f01(spark, d):
    images = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    sidecars = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    both = images.join(sidecars, "image_id", "left_semi").withColumn("has_sidecar", F.lit(True))
    return both.unionByName(images.join(sidecars, "image_id", "left_anti").withColumn("has_sidecar", F.lit(False)))


@register("F02", "SELECT o_orderkey AS image_id, c_name AS caption, count(*) AS dets FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def f02(spark, d):
    images, caps = v.table(spark, d, "orders").select("o_orderkey", "o_custkey"), v.table(spark, d, "customer").select("c_custkey", "c_name")
    dets = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("dets"))
    return images.join(caps, images["o_custkey"] == caps["c_custkey"]).join(dets, "o_orderkey").select(F.col("o_orderkey").alias("image_id"), F.col("c_name").alias("caption"), "dets")


def level_checks(spark, d):
    """Contact checks with a predicted level, by model."""
    image = F.col("image_id")
    predicted = F.when(image % 7 == 0, "Unknown").when(image % 5 < 2, "L1").when(image % 5 == 2, "L2").otherwise("L3")
    return contact_checks(spark, d).filter("level <> 'Unknown'").select((image % 3).cast("string").alias("model"), "image_id", "level", "contact_expected", "pass_contact_check", predicted.alias("predicted_level"))


LEVELS_SQL = f"""{CHECKS}, lv AS (SELECT CAST(image_id % 3 AS VARCHAR) AS model, image_id, level, contact_expected, pass_contact_check,
 CASE WHEN image_id % 7 = 0 THEN 'Unknown' WHEN image_id % 5 < 2 THEN 'L1' WHEN image_id % 5 = 2 THEN 'L2' ELSE 'L3' END AS predicted_level FROM chk WHERE level <> 'Unknown')"""


@register("A04", f"WITH {LEVELS_SQL} SELECT model, count(*) FILTER (contact_expected) AS l1_total, count(*) FILTER (contact_expected AND pass_contact_check) AS l1_correct, round(count(*) FILTER (contact_expected AND pass_contact_check) / nullif(count(*) FILTER (contact_expected), 0), 4) AS l1_accuracy FROM lv GROUP BY model", "v_boxes")
def a04(spark, d):
    from ..operators.scores import contact_statistics

    return contact_statistics(level_checks(spark, d)).select("model", "l1_total", "l1_correct", "l1_accuracy")


@register("A05", f"WITH {LEVELS_SQL} SELECT model, count(*) FILTER (predicted_level <> 'Unknown') AS total, count(*) FILTER (predicted_level = level) AS correct, round(count(*) FILTER (predicted_level = level) / count(*) FILTER (predicted_level <> 'Unknown'), 4) AS accuracy FROM lv GROUP BY model", "v_boxes")
def a05(spark, d):
    from ..operators.scores import contact_statistics

    return contact_statistics(level_checks(spark, d)).select("model", "total", "correct", "accuracy")


@register("A06", f"WITH {LEVELS_SQL} SELECT model, level, count(*) AS total, count(*) FILTER (predicted_level = level) AS correct, round(count(*) FILTER (predicted_level = level) / count(*), 4) AS accuracy FROM lv WHERE predicted_level <> 'Unknown' GROUP BY model, level", "v_boxes")
def a06(spark, d):
    from ..operators.scores import per_level_accuracy

    return per_level_accuracy(level_checks(spark, d))


@register("A07", f"""WITH {LEVELS_SQL} SELECT level, count(*) FILTER (predicted_level = 'L1') AS n_L1, count(*) FILTER (predicted_level = 'L2') AS n_L2, count(*) FILTER (predicted_level = 'L3') AS n_L3,
 round(100e0 * count(*) FILTER (predicted_level = 'L1') / count(*), 4) AS pct_L1, round(100e0 * count(*) FILTER (predicted_level = 'L2') / count(*), 4) AS pct_L2, round(100e0 * count(*) FILTER (predicted_level = 'L3') / count(*), 4) AS pct_L3
 FROM lv WHERE predicted_level <> 'Unknown' GROUP BY level""", "v_boxes")
def a07(spark, d):
    from ..operators.scores import confusion

    return confusion(level_checks(spark, d))
