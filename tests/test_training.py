"""Prefix scans of affine maps and what training loops compute, against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from vagari.operators import training as ops
from vagari.operators.scan import affine_scan


@pytest.mark.parametrize("run", [2, 3, 256])
def test_scan_equals_a_loop(spark, run):
    rng = random.Random(run)
    rows = [(key, step, rng.uniform(-1, 1), rng.uniform(-1, 1)) for key, n in (("a", 70), ("b", 1), (None, 5), ("c", 29)) for step in rng.sample(range(4 * n), n)]
    want = {}
    for key in {r[0] for r in rows}:
        x = 2.0
        for _, step, a, b in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            x = a * x + b
            want[key, step] = x
    df = spark.createDataFrame(rows, "k string, step long, a double, b double").repartition(3)
    got = {(r.k, r.step): r.value for r in affine_scan(df, ["k"], "step", F.col("a"), F.col("b"), 2.0, run=run).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert affine_scan(df.limit(0), ["k"], "step", F.col("a"), F.col("b"), run=run).count() == 0


def test_scan_with_nulls_and_zeros(spark):
    rows = [(1, 0, 1.0, 1.0), (1, 1, 0.0, 5.0), (1, 2, None, 1.0), (1, 3, 1.0, 1.0), (2, 0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k int, step long, a double, b double")
    got = {(r.k, r.step): r.value for r in affine_scan(df, ["k"], "step", F.col("a"), F.col("b"), run=2).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 5.0, (1, 2): None, (1, 3): None, (2, 0): 3.0}


def test_no_window_over_a_key(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS step", "0.5D AS a", "1D AS b")
    assert "Window" not in affine_scan(df, ["k"], "step", F.col("a"), F.col("b"), run=8)._jdf.queryExecution().executedPlan().toString()


def test_averages(spark):
    rows = [("w", 7, [1.0, 2.0]), ("w", 9, [3.0, 4.0]), ("w", 12, [5.0, 8.0]), ("w", 10, None), (None, 1, [1.0]), ("v", 3, [])]
    got = {(r.p, r.step, r.i): r.value for r in ops.weight_averages(spark.createDataFrame(rows, "p string, t int, v array<double>"), "p", "t", "v").collect()}
    d = 2 / 11
    assert got == pytest.approx({("w", 0, 0): 1.0, ("w", 0, 1): 2.0, ("w", 1, 0): 3.0, ("w", 1, 1): 4.0, ("w", 2, 0): d * 3 + (1 - d) * 5, ("w", 2, 1): d * 4 + (1 - d) * 8, (None, 0, 0): 1.0})
    final = {r.p: r.weights for r in ops.final_weights(ops.weight_averages(spark.createDataFrame(rows, "p string, t int, v array<double>"), "p", "t", "v"), "p").collect()}
    assert final["w"] == pytest.approx([d * 3 + (1 - d) * 5, d * 4 + (1 - d) * 8]) and final[None] == [1.0]


def test_decay_clip_and_loss(spark):
    got = spark.range(1).select(*(ops.decay(F.lit(n)).alias(f"d{n}") for n in (0, 1, 2, 10**7)), ops.clip_scale(F.lit(4.0), 1.0).alias("c"), ops.clip_scale(F.lit(0.0), 1.0).alias("z")).first()
    assert (got.d0, got.d1, got.d10000000, got.z) == (0.0, 0.0, 0.9999, 1.0) and got.d2 == pytest.approx(2 / 11) and got.c == pytest.approx(1 / (2 + 1e-6))
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 4.0), (1, None), (2, 5.0), (3, None)], "micro long, loss double")
    assert {r.step: r.loss for r in ops.gathered_loss(rows, "micro", "loss", 2).collect()} == {0: (2.0 + 4.0) / 2, 1: 5.0 / 2}
