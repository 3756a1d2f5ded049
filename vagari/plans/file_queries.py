"""Queries that list and order files: names come from the given tables, so that SQL can follow."""

from pyspark.sql import functions as F

from .. import schemas
from ..functions.lexicons import IMAGE_EXTENSIONS
from ..sources import files
from . import views as v
from .registry import register

NAMES = """nm AS (SELECT doc_id, '/data/' || source || '/img_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' ELSE '.txt' END AS path FROM documents)"""


def names(spark, d):
    k = F.col("doc_id") % 4
    ext = F.when(k == 0, ".jpg").when(k == 1, ".PNG").when(k == 2, ".jpeg").otherwise(".txt")
    return v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/img_"), F.col("doc_id").cast("string"), ext).alias("path"))


@register("S01", f"WITH {NAMES} SELECT path, 'img_' || doc_id AS image_id FROM nm WHERE doc_id % 4 < 3")
def s01(spark, d):
    return files.images(names(spark, d)).select("path", "image_id")


@register("S04", f"WITH {NAMES} SELECT split_part(path, '/', 3) AS dataset, split_part(path, '/', 4) AS name FROM nm WHERE split_part(path, '/', 3) IN ('src0', 'src3', 'src5')")
def s04(spark, d):
    return files.of_datasets(names(spark, d), ["src0", "src3", "src5"]).select("dataset", "name")


@register("S12", "SELECT DISTINCT source AS model FROM documents WHERE source LIKE 'src1%'")
def s12(spark, d):
    return files.model_directories(names(spark, d), "src1")


@register("S13", "SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS image_idx FROM documents")
def s13(spark, d):
    name = F.format_string("m/sentence_%03d_image_%d.png", "doc_id", F.col("doc_id") % 3)
    return v.table(spark, d, "documents").select("doc_id", files.image_index(name).alias("image_idx"))


@register("F12", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' ELSE '.png' END AS extension FROM documents")
def f12(spark, d):
    """Of the files of an image the one whose extension comes first in the list."""
    k = F.col("doc_id") % 3
    have = F.when(k == 0, F.array(F.lit(".PNG"), F.lit(".jpg"))).when(k == 1, F.array(F.lit(".jpeg"), F.lit(".JPG"))).otherwise(F.array(F.lit(".PNG"), F.lit(".png"), F.lit(".JPEG")))
    found = v.table(spark, d, "documents").select("doc_id", F.explode(have).alias("extension"))
    return files.first_extension(found, "doc_id", IMAGE_EXTENSIONS)


@register("F10", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f10(spark, d):
    have = v.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return v.table(spark, d, "documents").select("doc_id").join(have, "doc_id", "left_semi")


@register("W09", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY 'img_' || doc_id) AS place FROM documents")
def w09(spark, d):
    """Lexicographic order of names within a directory."""
    from ..operators.ordering import numbered

    rows = v.table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("name"))
    placed = numbered(rows, ["source", "name"], "nth")
    first = placed.groupBy(F.col("source").alias("folder")).agg(F.min("nth").alias("first"))
    return placed.join(first, F.col("source").eqNullSafe(F.col("folder"))).select("source", "doc_id", (F.col("nth") - F.col("first") + 1).alias("place"))


@register("S05", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS scene, doc_id % 3 > 0 AS ok FROM documents""")
def s05(spark, d):
    """Documents that don't parse keep their row."""
    good = F.to_json(F.struct(F.col("source").alias("scene")))
    text = F.when(F.col("doc_id") % 3 > 0, good).otherwise(F.lit('{"scene": '))
    return files.parsed(v.table(spark, d, "documents").select("doc_id", text.alias("value")), "value", "scene string").select("doc_id", "scene", "ok")


@register("S09", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role FROM conversations")
def s09(spark, d):
    """Elements of an array document with their ordinals."""
    turns = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    docs = turns.select("conv_id", F.to_json("t").alias("value"))
    return files.array_rows(docs, "turn bigint, role string").select("conv_id", "pos", "role")


@register("S10", "SELECT model, sentence_idx, CAST(image_idx - 1 AS INTEGER) AS image_idx, quantity FROM v_eval", "v_eval")
def s10(spark, d):
    """Documents that map a model to a sentence and its images."""
    image = F.struct("image_idx", F.struct(*(F.col(c) for c in ("quantity", "category", "direction", "distance", "scene"))).alias("scores"))
    sentences = v.evaluation(spark, d).groupBy("model", "sentence_idx").agg(F.transform(F.sort_array(F.collect_list(image)), lambda x: F.struct(x["scores"].alias("scores"))).alias("images"))
    docs = sentences.select(F.to_json(F.create_map("model", F.array(F.struct(F.col("sentence_idx").cast("string").alias("sentence"), "images")))).alias("value"))
    rows = files.keyed_rows(docs, schemas.HARD_EVAL)
    return rows.select("model", F.col("sentence").cast("bigint").alias("sentence_idx"), "image_idx", F.col("image.scores.quantity").alias("quantity"))


@register("S11", "SELECT key, level FROM v_map", "v_map")
def s11(spark, d):
    """The mapping of terms, from documents of some thousand entries."""
    rows = v.mapping(spark, d)
    part = F.pmod(F.xxhash64("key"), F.lit(-(-rows.count() // 4096) or 1))
    entries = rows.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("key", "level"))).alias("mapping"))
    return files.mapping_rows(entries.select(F.to_json(F.struct("mapping")).alias("value"))).select("key", "level")


@register("S22", """SELECT c_custkey AS run, 'ScoreParams.alpha' AS name, CASE WHEN c_custkey % 3 = 0 THEN '0.' || c_custkey % 10 ELSE '0.6' END AS value FROM customer
UNION ALL SELECT c_custkey, 'ScoreParams.scale', CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE '15.0' END FROM customer UNION ALL SELECT c_custkey, 'ScoreParams.pass_threshold', '10.0' FROM customer
UNION ALL SELECT c_custkey, 'SampleParams.count', '10' FROM customer UNION ALL SELECT c_custkey, 'SampleParams.seed', CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE '42' END FROM customer""")
def s22(spark, d):
    """Configurations of runs: the defaults of two pipelines, with what a run sets instead; settings that no pipeline has don't count."""
    from .. import params as p

    k = F.col("c_custkey")
    given = F.create_map(
        F.lit("ScoreParams.alpha"), F.when(k % 3 == 0, F.concat(F.lit("0."), (k % 10).cast("string"))), F.lit("ScoreParams.scale"), F.when(k % 5 == 0, k.cast("string")),
        F.lit("SampleParams.seed"), F.when(k % 7 > 0, F.col("c_name")), F.lit("unknown"), F.lit("x"),
    )
    return v.table(spark, d, "customer").select(k.alias("run"), F.explode(p.effective(given, p.ScoreParams(), p.SampleParams())).alias("name", "value"))
