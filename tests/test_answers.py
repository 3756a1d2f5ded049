"""Answer queries read whole texts."""

from conftest import SF

from vagari.plans import registry

registry.load()


def test_answers_are_whole(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'assistant'").collect()
    assert any(len(r.text) > 400 for r in rows)
    got = sorted((r.conv_id, r.turn, r.content) for r in registry.QUERIES["T33"](spark, SF).collect() if (r.conv_id + r.turn) % 6 == 4)
    assert got == sorted((r.conv_id, r.turn, "USER: q ASSISTANT: " + r.text) for r in rows if (r.conv_id + r.turn) % 6 == 4)
