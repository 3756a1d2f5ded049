"""Caption queries read whole texts."""

from conftest import SF

from vagari.plans import registry

registry.load()


def test_captions_are_whole(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert any(t and len(t) > 600 for t in texts.values())
    got = {r.image_id: r for r in registry.QUERIES["S14"](spark, SF).collect()}
    assert {k: r.spatial_caption for k, r in got.items()} == {k: "" if k % 5 == 0 else t or "" for k, t in texts.items()}
    assert {k: r.coca_caption for k, r in got.items()} == {k: "the  cat's\t" + t if k % 7 and t is not None else "" for k, t in texts.items()}
    assert {k: r.original_caption for k, r in got.items()} == {k: "original " + t if k % 2 == 0 and t is not None else "" for k, t in texts.items()}
