"""Every reference operator with SQL gives the same rows in Spark and DuckDB."""

import pandas as pd
import pytest
from conftest import SF
from oracle import rows_of_duckdb, rows_of_spark

from vagari.functions.geometry import SIDES
from vagari.params import DetectionParams
from vagari.plans import registry

registry.load()


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_query_equals_sql(spark, key):
    assert rows_of_spark(registry.QUERIES[key](spark, SF)) == rows_of_duckdb(registry.ORACLES[key], SF)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() and df.columns[0] == "model"
    assert set(e.oracle_sql()) <= set(e.queries())


def fuse_in_pandas(boxes, p):
    """A15 a second time, image by image."""

    def overlap(a, b) -> float:
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w < 0 or h < 0:
            return 0.0
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / union if union else 0.0

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for label, own in frame.groupby("label", sort=True):
            clusters: list[dict] = []
            for x in own.sort_values(["score", "detector", "box_id"], ascending=[False, True, True]).itertuples():
                if x.score < p.skip_score:
                    continue
                b = (x.x1, x.y1, x.x2, x.y2)
                found = [overlap(c["b"], b) for c in clusters]
                best = max(range(len(found)), key=lambda i: (found[i], -i), default=None)
                if best is None or found[best] <= p.fusion_iou:
                    clusters.append({"m": [(b, x.score)], "b": b})
                else:
                    m = clusters[best]["m"]
                    m.append((b, x.score))
                    total = sum(s for _, s in m)
                    clusters[best]["b"] = tuple(sum(q[i] * s for q, s in m) / total for i in range(4))
            for c in clusters:
                n = len(c["m"])
                rows.append((frame.image_id.iloc[0], label, sum(s for _, s in c["m"]) / n * min(n, p.detectors) / p.detectors, *c["b"], n))
        return pd.DataFrame(rows, columns=["image_id", "label", "score", *SIDES, "members"])

    return boxes.groupBy("image_id").applyInPandas(run, "image_id long, label string, score double, x1 double, y1 double, x2 double, y2 double, members int")


def test_fusion_equals_pandas(spark):
    from vagari.operators import boxes as ops
    from vagari.plans import views as v

    rows = v.boxes(spark, SF).withColumn("label", __import__("pyspark").sql.functions.col("core"))
    cols = ["image_id", "label", "members", "score", "x1", "y1", "x2", "y2"]
    near = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())
    assert near(ops.fused(rows)) == near(fuse_in_pandas(rows, DetectionParams()))


def test_streams_equal_batch(spark):
    from vagari.plans import views as v
    from vagari.streaming import status

    kept = ["status", "n"]
    batch = {r.status: r.n for r in v.status(spark, SF).groupBy("status").count().withColumnRenamed("count", "n").select(*kept).collect()}
    assert status.drained_counts(spark, SF) == batch
