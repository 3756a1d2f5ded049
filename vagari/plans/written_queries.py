"""Queries that write files in the shared folder and read them back; contents come from the given tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from .. import schemas
from ..operators import boxes as ops
from ..sources import datasource, files, sinks
from ..sources.shared import new_path
from . import views as v
from .detection_queries import LEVELS_SQL, P, level_checks
from .registry import register


def sidecars(spark, d):
    """A sidecar for each supplier; every seventh is cut off."""
    s = v.table(spark, d, "supplier")
    whole = F.to_json(F.struct(F.col("s_name").alias("spatial_caption"), F.col("s_suppkey").cast("string").alias("coca_caption")))
    content = F.when(F.col("s_suppkey") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    return s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"), content.alias("content"))


@register("S02", "SELECT CAST(s_suppkey AS VARCHAR) AS image_id, s_name AS spatial_caption FROM supplier WHERE s_suppkey % 7 <> 0")
def s02(spark, d):
    """Sidecars by the file; those that don't parse are left out."""
    path = new_path(spark, "sidecars")
    sinks.named_files(sidecars(spark, d), path)
    return files.json_documents(spark, path, schemas.CAPTION_SRC).filter("_corrupt IS NULL").select("image_id", "spatial_caption")


@register("K03", "SELECT s_suppkey || '_expanded' AS stem, s_name AS expanded_caption FROM supplier")
def k03(spark, d):
    """A file named after each image."""
    path = new_path(spark, "expanded")
    rows = v.table(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("_expanded.json")).alias("name"), F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("image_id"), F.col("s_name").alias("expanded_caption"))).alias("content"))
    sinks.named_files(rows, path)
    return files.json_documents(spark, path, schemas.EXPANDED).select(files.stem(F.col("path")).alias("stem"), "expanded_caption")


def pictures(spark, d):
    """Heads of PNG files of a size that follows from the key, in a folder for each nation; every fifth is broken, every third has capitals in its extension."""
    s, k = v.table(spark, d, "supplier"), F.col("s_suppkey")
    word = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), word(k + 100), word(k * 2 + 50), F.unhex(F.lit("0802000000")))
    ext = F.when(k % 3 == 0, ".PNG").otherwise(".jpg")
    return s.select(F.concat(F.col("s_nationkey").cast("string"), F.lit("/img_"), k.cast("string"), ext).alias("name"), F.when(k % 5 == 0, F.unhex(F.lit("00FF"))).otherwise(head).alias("content"))


@register("S03", "SELECT 'img_' || s_suppkey AS image_id, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey + 100 AS INTEGER) END AS width, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey * 2 + 50 AS INTEGER) END AS height, CASE WHEN s_suppkey % 5 = 0 THEN 'fail' ELSE 'ok' END AS state FROM supplier")
def s03(spark, d):
    path = new_path(spark, "pictures")
    sinks.named_files(pictures(spark, d), path)
    return files.image_sizes(spark, path).select("image_id", "width", "height", "state")


@register("S07", "SELECT 'img_' || s_suppkey AS image_id, row_number() OVER (ORDER BY 'img_' || s_suppkey) - 1 AS place FROM supplier WHERE s_suppkey % 3 <> 0")
def s07(spark, d):
    """Files of one pattern in the order of their names."""
    from ..operators.ordering import numbered

    path = new_path(spark, "pictures")
    sinks.named_files(pictures(spark, d), path)
    return numbered(files.images(files.listing(spark, path, "*.jpg")).select("image_id"), ["image_id"], "place")


@register("S16", "SELECT 'img_' || s_suppkey AS image_id, CAST(s_nationkey AS VARCHAR) AS label FROM supplier")
def s16(spark, d):
    """A folder of images; the folder that holds an image is its label."""
    path = new_path(spark, "pictures")
    sinks.named_files(pictures(spark, d), path)
    return files.images(files.listing(spark, path)).select("image_id", F.element_at(F.split("path", "/"), -2).alias("label"))


@register("S08", "SELECT conv_id, turn, text FROM conversations")
def s08(spark, d):
    path = new_path(spark, "lines")
    v.table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value")).write.text(path)
    return files.json_lines(spark, path, "conv_id long, turn long, text string").select("conv_id", "turn", "text")


@register("S18", "SELECT file, split, size FROM v_manifest", "v_manifest")
def s18(spark, d):
    """A split manifest: JSON objects, an array of at most MANIFEST_ROWS in each file's line."""
    path = new_path(spark, "manifest")
    part = F.expr(f"cast(split_part(file, '.', 1) AS bigint) div {MANIFEST_ROWS}")
    v.manifest(spark, d).groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct("file", "split", "size"))).alias("value")).select("value").write.text(path)
    return spark.read.schema(schemas.SPLIT_MANIFEST).json(path)


@register("S17", "SELECT file, size FROM v_manifest WHERE split IN ('train', 'val')", "v_manifest")
def s17(spark, d):
    """A custom data source over a manifest: planned by size, the filter on splits is the source's."""
    datasource.register(spark)
    path = new_path(spark, "manifest")
    v.manifest(spark, d).write.json(path)
    rows = spark.read.format("split_manifest").option("part_bytes", 16 << 20).load(path)
    return rows.filter(F.col("split").isin("train", "val")).select("file", "size")


@register("S15", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1')")
def s15(spark, d):
    """One configuration (a language) of a dataset in a local hub, with the columns that are wanted and a filter."""
    datasource.register(spark)
    path = new_path(spark, "hub")
    rows = v.table(spark, d, "documents").withColumn("config", F.coalesce("lang", F.lit("none")))
    for config in ("en", "de"):
        rows.filter(F.col("config") == config).drop("config").write.json(f"{path}/documents/{config}")
    read = spark.read.format("hub_dataset").schema("doc_id long, source string, n_chars long").option("name", "documents").option("config", "en").load(path)
    return read.filter(F.col("source").isin("src0", "src1")).select("doc_id", "n_chars")


SHARD_ROWS, MANIFEST_ROWS = 100, 1000


def samples(spark, d):
    """Samples of the documents, SHARD_ROWS keys a shard."""
    k = F.col("doc_id")
    parts = F.create_map(
        F.lit("json"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("coca_caption"))).cast("binary"),
        F.lit("jpg"), F.concat(F.lit("image "), k.cast("string")).cast("binary"), F.lit("metadata.json"), F.to_json(F.struct("lang", "source")).cast("binary"),
    )
    return v.table(spark, d, "documents").select(F.floor(k / SHARD_ROWS).alias("shard"), F.format_string("%09d", k).alias("key"), parts.alias("parts"))


@register("S19", "SELECT doc_id, coalesce(text, '') AS coca_caption, 'image ' || doc_id AS image, lang, source FROM documents")
def s19(spark, d):
    """Tar shards, written as rows come and read by byte ranges; parts of a sample meet by their stem."""
    from ..sources import tar

    path = new_path(spark, "shards")
    tar.write_shards(samples(spark, d), path)
    rows, _ = tar.samples(spark, path, range_bytes=1 << 20)
    meta = F.from_json("metadata", "lang string, source string")
    return rows.select(F.col("key").cast("bigint").alias("doc_id"), F.get_json_object("captions", "$.coca_caption").alias("coca_caption"), F.col("image").cast("string").alias("image"), meta["lang"].alias("lang"), meta["source"].alias("source"))


@register("K04", "SELECT doc_id, source, CASE WHEN n_chars % 2 = 0 THEN upper(source) ELSE '' END AS optimize_caption FROM documents")
def k04(spark, d):
    """A second version adds a column; readers see the newest one."""
    path = new_path(spark, "versions")
    sinks.new_version(v.table(spark, d, "documents").select("doc_id", "source"), path)
    one = sinks.latest(spark, path)
    chars = v.table(spark, d, "documents").select("doc_id", "n_chars")
    two = one.join(chars, "doc_id").select("doc_id", "source", F.when(F.col("n_chars") % 2 == 0, F.upper("source")).otherwise("").alias("optimize_caption"))
    sinks.new_version(two, path)
    return sinks.latest(spark, path)


@register("K06", "SELECT conv_id, turn, role FROM conversations")
def k06(spark, d):
    """Two batches are appended to the same lines."""
    path = new_path(spark, "appended")
    rows = v.table(spark, d, "conversations").select("conv_id", "turn", "role")
    for role in ("role = 'user'", "role <> 'user' OR role IS NULL"):
        sinks.append_lines(rows.filter(role), path)
    return spark.read.schema("conv_id long, turn long, role string").json(path)


@register("K07", "SELECT o_orderkey AS image_id, o_orderpriority AS model FROM orders")
def k07(spark, d):
    path = new_path(spark, "selected")
    sinks.documents(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("model")), path, "image_id")
    return spark.read.schema("image_id long, model string").json(path).select("image_id", "model")


@register("K13", f"WITH {LEVELS_SQL} SELECT model, image_id, level, predicted_level, pass_contact_check FROM lv", "v_boxes")
def k13(spark, d):
    """Results by level, one JSON document an image, in folders by key."""
    path = new_path(spark, "levels")
    sinks.documents(level_checks(spark, d).select("model", "image_id", "level", "predicted_level", "pass_contact_check"), path, "image_id")
    return spark.read.schema("model string, image_id long, level string, predicted_level string, pass_contact_check boolean").json(path).select("model", "image_id", "level", "predicted_level", "pass_contact_check")


@register("K18", """SELECT n_nationkey AS run, name, value FROM (SELECT n_nationkey, 'name' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT n_nationkey, 'note', 'a "quoted" ' || n_name FROM nation)""")
def k18(spark, d):
    """A line for each setting of each run, appended to the runs' files."""
    path = new_path(spark, "run-config")
    settings = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("note"), F.concat(F.lit('a "quoted" '), "n_name"))
    sinks.config_lines(v.table(spark, d, "nation").select(F.col("n_nationkey").alias("run"), settings.alias("settings")), "settings").write.mode("append").partitionBy("run").text(path)
    return spark.read.text(path).select(F.col("run").cast("bigint").alias("run"), F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))


@register("S06", "SELECT s_suppkey AS image_id, s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS complete FROM supplier")
def s06(spark, d):
    """Three-file lookup: images whose picture, caption and boxes are there, and the others for the audit."""
    path, k = new_path(spark, "triples"), F.col("s_suppkey")
    s = v.table(spark, d, "supplier").select("s_suppkey")
    kinds = (("images", ".jpg", 3), ("captions", ".json", 5), ("boxes", ".json", 7))
    for kind, ext, missing in kinds:
        sinks.named_files(s.filter(k % missing != 0).select(F.concat(F.lit(f"{kind}/"), k.cast("string"), F.lit(ext)).alias("name"), F.lit("x").alias("content")), path)
    found = files.listing(spark, path).select(files.stem(F.col("path")).cast("bigint").alias("image_id"), F.element_at(F.split("path", "/"), -2).alias("kind"))
    whole = found.groupBy("image_id").agg(F.countDistinct("kind").alias("kinds")).filter(F.col("kinds") == len(kinds)).select("image_id")
    images = s.select(k.alias("image_id"))
    return images.join(whole, "image_id", "left_semi").withColumn("complete", F.lit(True)).unionByName(images.join(whole, "image_id", "left_anti").withColumn("complete", F.lit(False)))


@register("S20", "SELECT s_suppkey * 100 AS step FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0")
def s20(spark, d):
    """Folders of checkpoints: the prefix counts, and a suffix that is no number is skipped."""
    path, k = new_path(spark, "run"), F.col("s_suppkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("checkpoint-"), k.cast("string"), F.lit("x"))).when(k % 11 == 0, F.concat(F.lit("logs-"), k.cast("string"))).otherwise(F.concat(F.lit("checkpoint-"), (k * 100).cast("string")))
    sinks.named_files(v.table(spark, d, "supplier").select(F.concat(name, F.lit("/weights")).alias("name"), F.lit("x").alias("content")), path)
    folder = files.listing(spark, path).select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()
    return folder.filter(F.col("folder").startswith("checkpoint-")).select(F.split_part("folder", F.lit("-"), F.lit(2)).try_cast("bigint").alias("step")).filter("step IS NOT NULL")


@register("S21", "SELECT 'run_' || max(n_nationkey) AS name FROM nation")
def s21(spark, d):
    """The newest of the runs: that of the greatest key was written last."""
    path, n = new_path(spark, "runs"), v.table(spark, d, "nation")
    last = n.agg(F.max("n_nationkey")).first()[0]
    rows = n.select("n_nationkey", F.concat(F.lit("run_"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("content"))
    sinks.named_files(rows.filter(F.col("n_nationkey") != last), path)
    time.sleep(1.1)  # file systems keep whole seconds
    sinks.named_files(rows.filter(F.col("n_nationkey") == last), path)
    return files.newest(files.listing(spark, path), "run_").select(F.element_at(F.split("path", "/"), -1).alias("name"))


@register("K01", "SELECT o_orderkey AS image_id, coalesce(n, 0) AS detections FROM orders LEFT JOIN (SELECT image_id, count(*) AS n FROM v_boxes WHERE score > 0.36e0 GROUP BY image_id) b ON o_orderkey = image_id", "v_boxes")
def k01(spark, d):
    """One list per image, written also where it is empty."""
    path = new_path(spark, "detections")
    det = F.struct(F.col("box_id").cast("string").alias("instance_id"), F.col("label").alias("category"), F.array("x1", "y1", "x2", "y2").alias("location"), "score")
    lists = ops.over_threshold(v.boxes(spark, d), P.score_threshold).groupBy("image_id").agg(F.collect_list(det).alias("dets"))
    images = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    rows = images.join(lists, "image_id", "left").withColumn("dets", F.coalesce("dets", F.array().cast(lists.schema["dets"].dataType)))
    sinks.documents(rows, path, "image_id")
    read = spark.read.schema(f"image_id long, dets array<{files.as_struct(schemas.DETECTION)}>").json(path)
    return read.select("image_id", F.size("dets").cast("long").alias("detections"))
