"""Hard and soft scores pair by position over all rows."""

from conftest import SF

from vagari.operators import scores as ops
from vagari.plans import registry

registry.load()


def test_all_images_pair(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    models = sorted(r.o_orderpriority for r in orders.select("o_orderpriority").distinct().collect())
    assert registry.QUERIES["F07"](spark, SF).count() == orders.count()
    # One model is in the hard results only, one in the soft ones only, and one has no hard images.
    both = [m for m in models if m not in ("1-URGENT", "5-LOW")]
    for key in ("F08", "U03"):
        assert sorted(r.model for r in registry.QUERIES[key](spark, SF).collect()) == both
    counts = {r.o_orderpriority: r["count"] for r in orders.groupBy("o_orderpriority").count().collect() if r.o_orderpriority in both and r.o_orderpriority != "3-MEDIUM"}
    assert {r.model: (r.hard_images, r.soft_images) for r in registry.QUERIES["P08"](spark, SF).collect()} == {m: (n, n) for m, n in counts.items()}


def test_unequal_lists_and_missing_models(spark):
    rows = lambda sizes: [(m, 1, i, float(i)) for m, n in sizes for i in range(1, n + 1)]
    hard = spark.createDataFrame(rows([("a", 30), ("b", 2), ("c", 3)]), "model string, sentence_idx int, image_idx int, hard_score double")
    soft = spark.createDataFrame(rows([("a", 25), ("b", 4), ("d", 5)]), "model string, sentence_idx int, image_idx int, soft_score double")
    got = sorted((r.model, r.image_idx, r.hard_score, r.soft_score) for r in ops.paired(hard, soft).collect())
    assert got == [("a", i, float(i), float(i)) for i in range(1, 26)] + [("b", i, float(i), float(i)) for i in (1, 2)]
