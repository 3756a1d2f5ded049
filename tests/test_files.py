"""Sources and sinks on small files."""

import io
import json
import struct
import tarfile

from pyspark.sql import functions as F

from vagari import schemas
from vagari.sources import datasource, files, sinks, tar


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0"


def test_images_and_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(640, 480))
    (tmp_path / "b.JPG").write_bytes(b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\x03" + b"\0" * 9)
    (tmp_path / "c.jpeg").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("x")
    assert {r.image_id for r in files.images(files.listing(spark, str(tmp_path))).collect()} == {"a", "b", "c"}
    got = {r.image_id: (r.width, r.height, r.state) for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a": (640, 480, "ok"), "b": (30, 20, "ok"), "c": (None, None, "fail")}


def test_json_documents_keep_broken_ones(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"spatial_caption": "a"}')
    (tmp_path / "2.json").write_text('{"spatial_caption": ')
    got = {r.image_id: (r.spatial_caption, r._corrupt is None) for r in files.json_documents(spark, str(tmp_path), schemas.CAPTION_SRC).collect()}
    assert got == {"1": ("a", True), "2": (None, False)}


def test_json_lists_and_maps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"scene": "room", "objects": ["x"]}, {"scene": "hall"}]))
    assert [(r.pos, r.scene) for r in files.json_array(spark, str(tmp_path / "a.json"), schemas.SENTENCE).orderBy("pos").collect()] == [(0, "room"), (1, "hall")]
    (tmp_path / "l.jsonl").write_text('{"scene": "room"}\n{"scene": "hall"}\n')
    assert files.json_lines(spark, str(tmp_path / "l.jsonl")).count() == 2
    hard = {"m": [{"sentence": "s", "images": [{"scores": {"quantity": 1, "detections": [{"box": [0, 0, 1, 1]}]}}, {"scores": {}}]}]}
    (tmp_path / "h.json").write_text(json.dumps(hard))
    rows = files.keyed_results(spark, str(tmp_path / "h.json"), schemas.HARD_EVAL).orderBy("image_idx").collect()
    assert [(r.model, r.sentence_idx, r.image_idx, r.image.scores.quantity) for r in rows] == [("m", 0, 0, 1.0), ("m", 0, 1, None)]
    (tmp_path / "f.json").write_text(json.dumps({"mapping": {"touching": "L1"}, "meta_info": {"definitions": {}}}))
    assert [tuple(r) for r in files.fuzzy_map(spark, str(tmp_path / "f.json")).collect()] == [("touching", "L1")]
    (tmp_path / "m.json").write_text(json.dumps([{"file": "0.tar", "split": "train", "size": 3}]))
    assert [tuple(r) for r in files.manifest(spark, str(tmp_path / "m.json")).collect()] == [("0.tar", "train", 3)]


def packed(path, members, form=tarfile.GNU_FORMAT):
    with tarfile.open(path, "w", format=form) as out:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        out.addfile(folder)
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))


MEMBERS = [("a.json", b'{"c": 1}'), ("a.jpg", b"img"), ("a.metadata.json", b"{}"), ("x/b.jpg", b"x" * 1500), ("c" * 150 + ".jpg", b""), ("\u00e9.json", b"\xff{}")]


def test_tar_samples(spark, tmp_path):
    for n, form in enumerate((tarfile.GNU_FORMAT, tarfile.PAX_FORMAT)):
        packed(tmp_path / f"{n}.tar", MEMBERS, form)
    (tmp_path / "9.tar").write_bytes(b"no tar at all")
    (tmp_path / "8.tar").write_bytes(b"")
    rows, faults = tar.samples(spark, str(tmp_path), range_bytes=1024)
    for n in (0, 1):
        got = {r.key: (r.captions, r.image and bytes(r.image), r.metadata) for r in rows.filter(F.col("shard").endswith(f"/{n}.tar")).collect()}
        assert got == {"a": ('{"c": 1}', b"img", "{}"), "b": (None, b"x" * 1500, None), "c" * 150: got["c" * 150], "\u00e9": (got["\u00e9"][0], None, None)}
        assert got["c" * 150][0] is None and not got["c" * 150][1]
    assert [(r.shard.rsplit("/")[-1], r.at, r.fault) for r in faults.collect()] == [("9.tar", 0, "header cut off")]


def test_broken_members_are_reported_and_what_stands_before_stays(spark, tmp_path):
    packed(tmp_path / "0.tar", [("a.jpg", b"1" * 600), ("b.jpg", b"2" * 600), ("c.jpg", b"3" * 600)])
    whole = (tmp_path / "0.tar").read_bytes()
    second = whole.index(b"b.jpg")
    (tmp_path / "1.tar").write_bytes(whole[:second] + b"?" * 200 + whole[second + 200 :])
    (tmp_path / "2.tar").write_bytes(whole[: second + 512 + 100])
    listed = tar.index(spark, str(tmp_path))
    got = {n: sorted((r.member or "", r.fault or "") for r in listed.filter(F.col("shard").endswith(f"/{n}.tar")).collect()) for n in range(3)}
    assert got[0] == [("a.jpg", ""), ("b.jpg", ""), ("c.jpg", "")]
    assert got[1][0][0] == "" and got[1][0][1].startswith("bad header") and got[1][1] == ("a.jpg", "")
    assert got[2] == [("a.jpg", ""), ("b.jpg", "data cut off")]
    rows, _ = tar.samples(spark, str(tmp_path))
    assert rows.count() == 5


def test_many_tasks_read_one_shard(spark, tmp_path):
    members = [(f"{i:04d}.jpg", bytes([i % 256]) * (i * 37 % 5000)) for i in range(400)]
    packed(tmp_path / "0.tar", members)
    read = tar.members(tar.index(spark, str(tmp_path)), range_bytes=64 << 10)
    got = read.withColumn("task", F.spark_partition_id()).collect()
    assert {r.member: bytes(r.data) for r in got} == dict(members) and len({r.task for r in got}) > 1


def test_written_shards_are_tars(spark, tmp_path):
    rows = [(s, f"{k:03d}", {"json": b"{}", "jpg": bytes([k])}) for s in ("x", "y") for k in range(30)] + [(None, "a", {}), ("x", None, {}), ("z", "a", None)]
    df = spark.createDataFrame(rows, "shard string, key string, parts map<string,binary>").repartition(5)
    assert tar.write_shards(df, str(tmp_path / "out")) == 3
    with tarfile.open(tmp_path / "out/x.tar") as f:
        assert f.getnames() == [f"{k:03d}.{e}" for k in range(30) for e in ("jpg", "json")]
    rows, faults = tar.samples(spark, str(tmp_path / "out"))
    assert rows.count() == 60 and faults.isEmpty()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc"), (2, None)], "index int, text string")
    sinks.tsv(df.select("index", sinks.one_line("text")), str(tmp_path / "t"))
    sinks.append_lines(df, str(tmp_path / "j"))
    sinks.append_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} >= {"1\ta b c"}
    one = sinks.new_version(df, str(tmp_path / "v"))
    two = sinks.new_version(df.filter("index = 1"), str(tmp_path / "v"))
    assert one != two and sinks.latest(spark, str(tmp_path / "v")).count() == 1
    assert [json.loads(r.value) for r in sinks.config_lines(spark.createDataFrame([({"lr": "0.1", "name": "x"},), ({},)], "m map<string,string>"), "m").orderBy("value").collect()] == [{"lr": "0.1"}, {"name": "x"}]


def test_models_are_stubs(spark):
    from vagari.functions.models import StubDetector, StubTagger, with_model

    df = spark.createDataFrame([("1", "red cup"), ("2", None)], "image_id string, caption string")
    tagged = with_model(df, StubTagger()).select("image_id", "output").collect()
    assert {r.image_id: list(r.output) for r in tagged} == {"1": ["red", "cup"], "2": []}
    boxes = with_model(df, StubDetector()).select("image_id", F.size("output").alias("n")).collect()
    assert {r.image_id: r.n for r in boxes} == {"1": 2, "2": 0}


MANIFEST = [{"file": f"{i}.tar", "split": ("train", "val", None)[i % 3], "size": i} for i in range(500)]


def manifest_files(folder, files=3):
    folder.mkdir(exist_ok=True)
    for n in range(files):
        (folder / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in MANIFEST[n::files]) + ("no json\n[1]\n" if n == 1 else "") + ('{"file": "last"}' if n == 2 else ""))
    (folder / "_SUCCESS").write_text("")


def test_manifest_source(spark, tmp_path):
    datasource.register(spark)
    manifest_files(tmp_path / "m")
    want = sorted([(x["file"], x["split"], x["size"]) for x in MANIFEST] + [("last", None, None)], key=str)
    for part in (7, 333, 1 << 20):
        df = spark.read.format("split_manifest").option("part_bytes", part).load(str(tmp_path / "m"))
        assert sorted(map(tuple, df.collect()), key=str) == want
    assert df.rdd.getNumPartitions() == 1
    some = df.filter("split = 'val' AND size > 100")
    assert "EqualTo(split, val)" in some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) or "split" in some._jdf.queryExecution().toString()
    assert sorted(r.file for r in some.collect()) == sorted(x["file"] for x in MANIFEST if x["split"] == "val" and x["size"] > 100)
    assert df.filter("split IN ('val', 'test') AND split IN ('val', 'train')").count() == sum(x["split"] == "val" for x in MANIFEST)
    assert df.filter("split IS NULL").count() == sum(x["split"] is None for x in MANIFEST) + 1
    one = spark.read.format("split_manifest").schema("size long").load(str(tmp_path / "m"))
    assert one.columns == ["size"] and one.agg(F.sum("size")).first()[0] == sum(range(500))


def test_plan_covers_each_byte_once():
    files_, part = [("a", 10), ("b", 0), ("c", 25), ("d", 3)], 8
    plan = datasource.planned(files_, part)
    assert all(sum(hi - lo for _, lo, hi in p.ranges) <= part for p in plan)
    assert sorted((f, b) for p in plan for f, lo, hi in p.ranges for b in range(lo, hi)) == sorted((f, b) for f, n in files_ for b in range(n))


def test_manifest_stream_goes_on_after_a_restart(spark, tmp_path):
    datasource.register(spark)
    manifest_files(tmp_path / "m", 2)
    folder, out, progress = (str(tmp_path / n) for n in ("m", "out", "progress"))

    def run():
        rows = spark.readStream.format("split_manifest").load(folder)
        rows.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 500
    (tmp_path / "m" / "9.json").write_text('{"file": "new", "split": "val", "size": 1}\n')
    assert run() == 501 and run() == 501


def test_hub(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "set" / "default").mkdir(parents=True)
    (tmp_path / "set" / "default" / "x.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": null}\n')
    hub = spark.read.format("hub_dataset").schema("b string, a long").option("name", "set")
    assert sorted(map(tuple, hub.load(str(tmp_path)).collect()), key=str) == sorted([("x", 1), (None, None)], key=str)
    assert hub.option("config", "missing").load(str(tmp_path)).count() == 0
