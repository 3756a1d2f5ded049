"""Operators run on all rows of their tables."""

import json

from conftest import SF

from vagari.plans import registry
from vagari.plans import views as v

registry.load()


def test_union_has_both_lists(spark):
    rows = [(r.image_id, r.pos, r.phrase) for r in v.phrases(spark, SF).collect()]
    got = sorted(map(tuple, registry.QUERIES["U01"](spark, SF).select("image_id", "pos", "phrase").collect()))
    assert got == sorted(rows + [(i, k, "pile of " + p) for i, k, p in rows])


def test_every_neighbour_pair_has_an_iou(spark):
    key = lambda q: sorted((r.image_id, r.i, r.iou) for r in registry.QUERIES[q](spark, SF).collect())
    assert key("G04") == key("G03")


def test_every_turn_is_serialised(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role").collect()
    got = sorted(sorted(json.loads(r.json).items()) for r in registry.QUERIES["T32"](spark, SF).collect())
    assert got == sorted(sorted(r.asDict().items()) for r in rows)
