"""Operators on detections: one row per box, or one array of boxes per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry as geo
from ..params import DetectionParams

FUSED = "array<struct<x1:double,y1:double,x2:double,y2:double,total:double,n:int,sx1:double,sy1:double,sx2:double,sy2:double>>"


def over_threshold(boxes: DataFrame, threshold: float) -> DataFrame:
    """Strictly above."""
    return boxes.filter(F.col("score") > threshold)


def same_core_pairs(boxes: DataFrame, keys: list[str], order: str, threshold: float) -> DataFrame:
    """pairs i < j of one image and core noun that overlap by more than the threshold.

    The join is on image and core noun, whose groups are one image's boxes of one
    kind; the order and overlap conditions are checked inside it.
    """
    a = boxes.select(*keys, F.col(order).alias("i"), geo.box(*(F.col(s) for s in geo.SIDES)).alias("a"))
    b = boxes.select(*keys, F.col(order).alias("j"), geo.box(*(F.col(s) for s in geo.SIDES)).alias("b"))
    pairs = a.join(b, keys).filter("i < j").withColumn("iou", geo.iou(F.col("a"), F.col("b")))
    return pairs.filter(F.col("iou") > threshold).select(*keys, "i", "j", "iou")


def suppress(boxes: Column, threshold: float) -> Column:
    """Positions (from 0) that stay of an array of structs with a box 'b' and a 'score', in scan order.

    Scan i < j: where both are still there and overlap by more than the
    threshold, the lower score goes (a tie takes j). Once box i is gone its scan
    ends; what it removed before stays removed. The fold over i carries the flags
    of removed boxes; a scan looks at each other box twice.
    """
    n = F.size(boxes)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def scan(gone: Column, i: Column) -> Column:
        own = F.get(boxes, i)
        hit = lambda k: (k > i) & ~F.get(gone, k) & (geo.iou(own["b"], F.get(boxes, k)["b"]) > threshold)
        stop = F.coalesce(F.array_min(F.filter(places, lambda k: hit(k) & (F.get(boxes, k)["score"] > own["score"]))), n)
        after = F.transform(gone, lambda g, k: g | (hit(k) & (k < stop)) | ((k == i) & (stop < n)))
        return F.when(F.get(gone, i), gone).otherwise(after)

    flags = F.aggregate(places, F.array_repeat(F.lit(False), n), scan)
    return F.filter(F.transform(flags, lambda g, i: F.when(~g, i)), lambda i: i.isNotNull())


def suppressed(boxes: DataFrame, keys: list[str], order: list, threshold: float) -> DataFrame:
    """W02 on rows: the boxes that stay, by image and core noun. 'order' gives the scan order."""
    members = F.struct(*order, geo.box(*(F.col(s) for s in geo.SIDES)).alias("b"), "score", F.col("box_id").alias("id"))
    groups = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(members)).alias("m"))
    kept = suppress(F.col("m"), threshold)
    return groups.select(*keys, F.explode(F.transform(kept, lambda i: F.get(F.col("m"), i)["id"])).alias("box_id"))


def fuse(boxes: Column, p: DetectionParams = DetectionParams()) -> Column:
    """Weighted boxes fusion of one image's boxes of one label, given by score descending.

    Each box joins the fused box that it overlaps most, if by more than
    p.fusion_iou (the earliest of equals), else it starts one. A fused box has the
    score-weighted mean of its members' sides and their mean score; at the end the
    score is multiplied by the share of detectors, at most 1. By score descending.
    """

    def as_box(c: Column) -> Column:
        return F.struct(*(c[s].alias(s) for s in geo.SIDES))

    def fresh(x: Column) -> Column:
        return F.struct(*(x["b"][s].alias(s) for s in geo.SIDES), x["score"].alias("total"), F.lit(1).alias("n"), *((x["b"][s] * x["score"]).alias(f"s{s}") for s in geo.SIDES))

    def grown(c: Column, x: Column) -> Column:
        total = c["total"] + x["score"]
        sums = {s: c[f"s{s}"] + x["b"][s] * x["score"] for s in geo.SIDES}
        return F.struct(*((sums[s] / total).alias(s) for s in geo.SIDES), total.alias("total"), (c["n"] + 1).alias("n"), *(sums[s].alias(f"s{s}") for s in geo.SIDES))

    def put(clusters: Column, x: Column) -> Column:
        overlaps = F.transform(clusters, lambda c: geo.iou(as_box(c), x["b"]))
        best = F.array_max(overlaps)
        at = F.when(best > p.fusion_iou, F.array_position(overlaps, best).cast("int")).otherwise(F.lit(0))
        joined = F.transform(clusters, lambda c, i: F.when(i + 1 == at, grown(c, x)).otherwise(c))
        return F.when(at > 0, joined).otherwise(F.concat(clusters, F.array(fresh(x)))).cast(FUSED)

    used = F.filter(boxes, lambda x: x["score"] >= p.skip_score)
    fused = F.aggregate(used, F.array().cast(FUSED), put)
    n = float(p.detectors)
    score = lambda c: c["total"] / c["n"] * F.least(c["n"].cast("double"), F.lit(n)) / n
    return F.transform(fused, lambda c: F.struct(score(c).alias("score"), *(c[s].alias(s) for s in geo.SIDES), c["n"].alias("members")))


def fused(boxes: DataFrame, p: DetectionParams = DetectionParams()) -> DataFrame:
    """A15 on rows of image_id, label, detector, box_id, sides and score. Ties in score go by detector, then box_id."""
    member = F.struct((-F.col("score")).alias("k"), "detector", "box_id", "score", geo.box(*(F.col(s) for s in geo.SIDES)).alias("b"))
    groups = boxes.groupBy("image_id", "label").agg(F.sort_array(F.collect_list(member)).alias("m"))
    out = groups.select("image_id", "label", F.posexplode(fuse(F.col("m"), p)).alias("made", "f"))
    w = W.Window.partitionBy("image_id").orderBy(F.desc("f.score"), "label", "made")
    return out.select("image_id", "label", F.row_number().over(w).alias("fused_rank"), "f.score", *(f"f.{s}" for s in geo.SIDES), "f.members")


def with_instance_ids(boxes: DataFrame, order: list) -> DataFrame:
    """label_1, label_2, ... within an image."""
    n = F.row_number().over(W.Window.partitionBy("image_id", "label").orderBy(*order))
    return boxes.withColumn("instance_id", F.concat_ws("_", "label", n.cast("string")))
