"""Hand-computed cases, above all the corners."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vagari.functions import geometry as geo
from vagari.functions import scoring as sc
from vagari.functions import text as tx
from vagari.operators import boxes as bx
from vagari.operators import captions as cp
from vagari.operators import keywords as kw
from vagari.operators import scores as so
from vagari.operators.ordering import numbered
from vagari.params import CaptionParams


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lit(values):
    return F.array(*(F.lit(v) for v in values))


def box(*s):
    return geo.box(*(F.lit(float(x)) for x in s))


@pytest.mark.parametrize(
    "b, iou, gap, touch",
    [((0, 0, 10, 10), 1.0, 0, True), ((5, 0, 15, 10), 1 / 3, 0, True), ((10, 0, 20, 10), 0.0, 0, True), ((12, 0, 20, 10), 0.0, 2, True), ((13, 14, 20, 20), 0.0, 5, False), ((30, 0, 40, 10), 0.0, 20, False)],
)
def test_geometry(spark, b, iou, gap, touch):
    a, b = box(0, 0, 10, 10), box(*b)
    o, d = geo.iou(a, b), geo.distance(a, b)
    assert one(spark, o, d, geo.contact(o, d)) == (pytest.approx(iou), gap, touch)
    assert one(spark, geo.iou(b, a)) == (pytest.approx(iou),)


def test_degenerate_boxes_and_missing_second_box(spark):
    z = box(1, 1, 1, 1)
    assert one(spark, geo.iou(z, z)) == (0.0,)
    none = F.lit(None).cast("double")
    for level in ("L1", "L2", "L3"):
        r = spark.range(1).select(geo.check_contact(F.lit(False), none, none, F.lit(level)).alias("c")).select("c.*").first()
        assert (r.contact_detected, r.pass_contact_check, r.pixel_distance, r.reason) == (False, False, float("inf"), "Less than 2 objects detected")


@pytest.mark.parametrize("hard, soft, want", [(5, 2.6, (1.0, 0.4, 0.76, 11.4)), (4, 2.0, (0.8, 0.25, 0.58, 8.7)), (5, 1.4, (1.0, 0.1, 0.64, 9.6)), (0, 0.0, (0.0, -0.25, -0.1, -1.5))])
def test_composite(spark, hard, soft, want):
    assert tuple(spark.range(1).select(sc.composite(F.lit(float(hard)), F.lit(soft)).alias("c")).select("c.*").first()) == want


def test_consistency_corners(spark):
    df = spark.createDataFrame([("a", 11.4), ("a", 8.7), ("a", 10.2), ("b", 3.0), ("z", 0.0), ("z", 0.0)], "model string, score_final_scaled double")
    got = {r.model: tuple(r)[1:] for r in so.consistency(df, ["model"]).collect()}
    assert got == {"a": (10.1, 1.3528, 0.1339, 0.8661), "b": (3.0, 0.0, 0.0, 1.0), "z": (0.0, 0.0, 0.0, 0.0)}
    assert tuple(so.pass_rate(df.filter("model = 'a'"), ["model"]).first()) == ("a", 8.7, False, 2, 0.6667)


def test_softmax(spark):
    p = sc.softmax(lit([2.0, 1.0, 0.0]))
    probs, weighted = one(spark, p, sc.weighted(p, lit([0.4, 0.25, 0.1])))
    assert probs == pytest.approx([0.6652, 0.2447, 0.0900], abs=1e-4) and sum(probs) == pytest.approx(1)
    assert weighted == pytest.approx(0.3363, abs=1e-4)
    assert one(spark, sc.weighted(sc.softmax(lit([5.0])), lit([0.4])) * 4 + 1) == (pytest.approx(2.6),)


def test_text(spark):
    f = F.lit
    assert one(spark, tx.preprocess(f("a  cat's\n toy"))) == ("a cat is toy",)
    assert one(spark, tx.yes_indices(f("1. yes\n2. no\n3) Yes"), 3), tx.yes_indices(f("sure, yes\nno"), 2)) == ([0, 2], [0])
    assert one(spark, tx.clean_answer(f("Output: Cat near dog.\nExtra")), tx.clean_answer(f("Output:\nCat near dog."))) == ("Cat near dog.", "")
    assert one(spark, F.size(tx.json_list(f('ok [{"sentence":"x"}] bye'))), F.size(tx.json_list(f("ok [{bad] bye"))), F.size(tx.json_list(f("none")))) == (1, 0, 0)
    assert one(spark, tx.model_type(f("/m/PixArt-Sigma"))) == ("stable_diffusion",)
    assert tuple(spark.range(1).select(tx.shard_range(f("{0..12}.tar")).alias("r")).select("r.*").first()) == (0, 12)
    assert one(spark, tx.duration(f(59.94)), tx.duration(f(90.0)), tx.duration(f(7200.0))) == ("59.9 seconds", "1.5 minutes", "2.00 hours")
    assert one(spark, *(tx.index_of_file(f(n)) for n in ("none.json", "a_12.json", "12_expanded.json", "7-x.json"))) == (None, None, 12, 7)
    said = lambda t: tx.assistant_answer(f(t), f("abc"))
    assert one(spark, said("x ASSISTANT: a ASSISTANT:  b\n"), said("the assistant\tyes"), said(" My Assistant: b "), said("abc d")) == ("b", "yes", "My Assistant: b", "d")
    assert one(spark, tx.is_object_phrase(f("in front of")), tx.is_object_phrase(f("red cup")), tx.is_object_phrase(f("on left"))) == (False, True, False)


def test_level_lookup_defaults(spark):
    terms = spark.createDataFrame([("  Touching ",), ("absent",), (None,)], "term string")
    levels = spark.createDataFrame([("touching", "L1")], "key string, level string")
    got = terms.withColumn("key", tx.fuzzy_key(F.col("term"))).join(levels, "key", "left").select(F.coalesce("level", F.lit("Unknown"))).collect()
    assert sorted(r[0] for r in got) == ["L1", "Unknown", "Unknown"]


def test_longest_phrase_by_root(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(["red cup", "cup", "tall red cup", "dog", " "])], "k int, pos int, phrase string")
    got = kw.longest_by_root(rows, "k").orderBy("first_pos").select("phrase").collect()
    assert [r[0] for r in got] == ["tall red cup", "dog"]


def scan(spark, rows):
    df = spark.createDataFrame([(1, "c", i, s, *map(float, b)) for i, (s, b) in enumerate(rows)], "image_id int, core string, box_id int, score double, x1 double, y1 double, x2 double, y2 double")
    return sorted(r.box_id for r in bx.suppressed(df, ["image_id", "core"], ["box_id"], 0.85).collect())


def test_suppression_in_scan_order(spark):
    a, b = (0, 0, 100, 10), (10, 0, 110, 10)
    assert scan(spark, [(0.9, a), (0.7, (5, 0, 105, 10)), (0.8, b)]) == [0, 2]  # the middle one is gone before it compares
    assert scan(spark, [(0.5, a), (0.5, a)]) == [0]  # a tie keeps the earlier
    assert scan(spark, [(0.5, a), (0.6, a)]) == [1]  # a later box of higher score wins
    assert scan(spark, [(0.5, a)]) == [0]


def test_fusion_pair(spark):
    rows = [(1, "c", 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, "c", 1, 1, 0.6, 1.0, 0.0, 11.0, 10.0), (1, "d", 1, 2, 0.9, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image_id long, label string, detector int, box_id long, score double, x1 double, y1 double, x2 double, y2 double")
    got = {r.label: (round(r.x1, 6), round(r.x2, 6), round(r.score, 6), r.members, r.fused_rank) for r in bx.fused(df).collect()}
    assert got == {"c": (0.4, 10.4, 0.5, 2, 1), "d": (0.0, 1.0, 0.3, 1, 2)}


def test_retention_and_ranking(spark):
    ck = spark.createDataFrame([("r", s) for s in (1500, 3000, 4500, 6000, 7500)], "run string, step long")
    assert [r.step for r in cp.keep_newest(ck, "run", "step", 5).filter("delete").collect()] == [1500]
    st = spark.createDataFrame([("b", 9.0), ("a", 9.0), ("c", 9.5)], "model string, avg_composite_score double")
    assert [r.model for r in so.ranked(st).orderBy("rank").collect()] == ["c", "a", "b"]
    files = spark.createDataFrame([(i,) for i in range(5)], "i int")
    assert [r.worker for r in cp.round_robin(files, ["i"], 2).orderBy("i").collect()] == [0, 1, 0, 1, 0]


def test_caption_fallbacks(spark):
    from vagari.params import CaptionParams

    df = spark.createDataFrame([("optimized", "", "s", "g", "o", "x"), ("spatial", "", "", "g", "o", "x"), ("general", "", "", "g", "o", "src0"), ("general", "", "", "", "", "x"), ("general", None, None, "g", None, "src0")], "kind string, a string, b string, c string, d string, src string")
    got = df.select(cp.caption(*(F.col(c) for c in ("kind", "a", "b", "c", "d", "src")), CaptionParams())).collect()
    assert [r[0] for r in got] == ["s", "g", "o", "", "g"]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_fixed_rounds_as_python_does(spark, digits):
    rng = random.Random(digits)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.125, 0.375, 1.005, 2.675, 8.25, 8.75, 59.95, 0.005, 0.015, 1e-9, 5e-324, 0.95, 0.995, 99.995, 123456.25, 1e9 + 0.125]
    values += [rng.random() * 10 ** rng.randrange(-3, 7) for _ in range(300)] + [rng.randrange(10**6) / 8 for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", tx.fixed(F.col("x"), digits).alias("s")).collect()
    assert [(r.x, r.s) for r in got] == [(x, f"{x:.{digits}f}") for x in values]


@pytest.mark.parametrize("ranges", [None, 1, 7, 40, 400])
def test_numbers_follow_the_order(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), i) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, i int").repartition(5)
    got = {(r.s, r.i): r.nth for r in numbered(df, ["s", "i"], "nth", ranges).collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    assert numbered(df.limit(0), ["s", "i"], "nth").count() == 0


def test_fallback_goes_down_the_ladder():
    from vagari.functions.models import with_fallback

    def fail(text):
        def call():
            raise RuntimeError(text)

        return call

    ok = lambda: 1
    assert with_fallback([("sample", ok)]) == (1, "sample")
    assert with_fallback([("sample", fail("CUDA error")), ("greedy", fail("x")), ("reload", ok), ("cpu", ok)]) == (1, "reload")
    assert with_fallback([("sample", fail("NaN")), ("greedy", fail("x")), ("reload", ok), ("cpu", ok)], reloads=False) == (1, "cpu")
    with pytest.raises(RuntimeError, match="no such file"):
        with_fallback([("sample", fail("no such file")), ("greedy", ok)])
    with pytest.raises(RuntimeError, match="all attempts"):
        with_fallback([("sample", fail("Inf")), ("greedy", fail("y"))])


def test_training_caption(spark):
    p = CaptionParams()
    said = lambda name, kind, o, s, g, w, src="x", **own: one(spark, cp.training_caption(*(F.lit(x) for x in (name, kind, o, s, g, w, src, 1)), replace(p, **own)))[0]
    assert said(None, "optimized", "", "near. left. right", "cat", None) == "near. left. right"
    assert said(None, "optimized", None, "near. left. right", "cat", None, spatial="short") == " right"
    assert said("", "general", "o", "s", "cat", "w", src="src0") == "w" and said("", "general", "o", "s", "cat", "", src="src0") == "cat"
    assert said("original_caption", "general", "o", "s", "cat", None) == "" and said("original_caption", "spatial", "o", "s", "cat", None, general="original_caption") == "cat"
    assert said(None, "spatial", "o", None, None, None) == ""
    pick = lambda values, draw, train=True: one(spark, cp.one_of(F.lit(values).cast("array<string>"), F.lit(draw), train))[0]
    assert (pick(["a", "b", "c"], 4), pick(["a", "b"], 1, False), pick([], 3)) == ("b", "a", None)
