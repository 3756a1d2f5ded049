"""The shuffle buffer against a plain one."""

import hashlib

import pytest

from vagari.operators.shuffle_buffer import buffered


def plain(keys, seed, places):
    draw = lambda k: int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
    held, out = [], []
    for k in sorted(keys):
        if len(held) < places:
            held.append(k)
        else:
            at = draw(k) % places
            out.append(held[at])
            held[at] = k
    return out + sorted(held, key=lambda k: (draw(k), k))


@pytest.mark.parametrize("places", [1, 7, 1000])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_buffer(spark, places, batch):
    rows = [(s, k, f"x{k}") for s, n in (("a", 40), ("b", 1), (None, 23)) for k in range(n)]
    df = spark.createDataFrame(rows, "shard string, k int, x string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = buffered(df, "shard", ["k"], "9", places).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((str(r.shard), r.k, r.x) for r in got) == sorted((str(s), k, x) for s, k, x in rows)
    for shard in ("a", "b", None):
        keys = [k for s, k, _ in rows if s == shard]
        assert [r.k for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.place)] == plain(keys, "9", places)
        assert all(r.place >= r.k - places for r in got if r.shard == shard)


def test_empty_table(spark):
    assert buffered(spark.createDataFrame([], "shard int, k int"), "shard", ["k"], "1").count() == 0
