"""Queries on captions, samples, splits, status rows and manifests."""

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import captions as ops
from ..params import CaptionParams, SampleParams
from ..schemas import CAPTION_SRC
from ..sources import files
from ..sources.shared import new_path
from . import views as v
from .registry import register

P, S = CaptionParams(), SampleParams()
H = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
DRAW = H.format("'42:' || image_id")
KIND = H.format("'42:kind:' || image_id") + " / 4294967296e0 * 100"
CHOSEN = f"CASE WHEN {KIND} < 50 THEN 'optimized' WHEN {KIND} < 75 THEN 'spatial' ELSE 'general' END"
PLAIN = "CASE WHEN source = 'src0' THEN coalesce(nullif(original, ''), nullif(general, '')) ELSE nullif(general, '') END"


@register("T01", r"SELECT image_id, replace(replace(replace(trim(regexp_replace(general, '\s+', ' ', 'g')), '''s', ' is'), '''re', ' are'), '''m', ' am') AS caption FROM v_caption", "v_caption")
def t01(spark, d):
    return v.captions(spark, d).select("image_id", tx.preprocess(F.col("general")).alias("caption"))


@register("P01", "SELECT image_id FROM v_caption WHERE length(trim(spatial)) > 0", "v_caption")
def p01(spark, d):
    return v.captions(spark, d).filter(F.length(F.trim("spatial")) > 0).select("image_id")


@register("P06", "SELECT image_id, coalesce(spatial, '') AS spatial, coalesce(general, spatial, '') AS coca FROM v_caption", "v_caption")
def p06(spark, d):
    return v.captions(spark, d).select("image_id", F.coalesce("spatial", F.lit("")).alias("spatial"), F.coalesce("general", "spatial", F.lit("")).alias("coca"))


@register("S14", "SELECT image_id, coalesce(general, '') AS coca_caption, coalesce(spatial, '') AS spatial_caption, coalesce(original, '') AS original_caption FROM v_caption", "v_caption")
def s14(spark, d):
    """A training corpus, written as JSON and scanned; absent fields are empty."""
    path = new_path(spark, "corpus")
    names = (("general", "coca_caption"), ("spatial", "spatial_caption"), ("original", "original_caption"))
    v.captions(spark, d).select(F.to_json(F.struct(F.col("image_id").cast("string").alias("image_id"), *(F.col(c).alias(n) for c, n in names))).alias("value")).write.text(path)
    return files.json_lines(spark, path, CAPTION_SRC).select(F.col("image_id").cast("bigint").alias("image_id"), *(F.coalesce(n, F.lit("")).alias(n) for _, n in names))


@register("W10", f"SELECT image_id FROM v_caption ORDER BY {DRAW}, image_id LIMIT 10", "v_caption")
def w10(spark, d):
    return ops.sample(v.captions(spark, d).select("image_id"), "image_id", S.count, S.seed)


@register("W11", f"SELECT image_id FROM v_caption ORDER BY {DRAW}, image_id LIMIT (SELECT CAST(floor(0.25 * count(*)) AS BIGINT) FROM v_caption)", "v_caption")
def w11(spark, d):
    return ops.truncated(v.captions(spark, d).select("image_id"), "image_id", 0.25, S.seed)


@register("W15", f"SELECT image_id FROM v_caption ORDER BY {DRAW}, image_id LIMIT 64", "v_caption")
def w15(spark, d):
    return ops.sample(v.captions(spark, d).select("image_id"), "image_id", 64, S.seed)


@register("W12", f"SELECT image_id, CASE WHEN {H.format(chr(39) + '42:split:' + chr(39) + ' || image_id')} / 4294967296e0 < 0.1e0 THEN 'validation' ELSE 'train' END AS split FROM v_caption", "v_caption")
def w12(spark, d):
    return ops.with_split(v.captions(spark, d), "image_id", 0.1, S.seed).select("image_id", "split")


@register("W13", f"SELECT image_id, {CHOSEN} AS kind FROM v_caption", "v_caption")
def w13(spark, d):
    return v.captions(spark, d).select("image_id", ops.chosen_kind(F.col("image_id"), P).alias("kind"))


@register("G20", f"SELECT {CHOSEN} AS kind, count(*) AS n FROM v_caption GROUP BY 1", "v_caption")
def g20(spark, d):
    return v.captions(spark, d).select(ops.chosen_kind(F.col("image_id"), P).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@register("W14", f"""SELECT image_id, 0 AS copy, 'second_optimize_caption' AS preferred FROM v_caption UNION ALL
SELECT image_id, 1, CASE WHEN {H.format("'42:coin:' || image_id")} % 2 = 0 THEN 'spatial_caption' WHEN source = 'src0' THEN 'original_caption' ELSE 'coca_caption' END FROM v_caption""", "v_caption")
def w14(spark, d):
    return ops.expanded(v.captions(spark, d).select("image_id", "source"), "image_id", F.col("source"), P).select("image_id", "copy", F.col("_preferred_caption").alias("preferred"))


@register("W16", f"""WITH a AS (SELECT *, CASE image_id % 7 WHEN 0 THEN 'spatial_caption' WHEN 1 THEN 'coca_caption' WHEN 2 THEN 'original_caption' WHEN 3 THEN 'second_optimize_caption' WHEN 4 THEN '' END AS preferred, {CHOSEN} AS kind, string_split(spatial, '.') AS s, {H.format("'42:sentence:' || image_id")} AS h FROM v_caption),
b AS (SELECT *, coalesce(nullif(preferred, ''), CASE kind WHEN 'optimized' THEN 'second_optimize_caption' WHEN 'spatial' THEN 'spatial_caption' ELSE 'coca_caption' END) AS n FROM a),
c AS (SELECT * REPLACE (CASE WHEN n = 'second_optimize_caption' AND coalesce(optimized, '') = '' THEN 'spatial_caption' ELSE n END AS n) FROM b),
e AS (SELECT * REPLACE (CASE WHEN n = 'spatial_caption' AND coalesce(spatial, '') = '' THEN 'coca_caption' ELSE n END AS n) FROM c),
f AS (SELECT * REPLACE (CASE WHEN n = 'coca_caption' AND source = 'src0' AND original <> '' THEN 'original_caption' ELSE n END AS n) FROM e)
SELECT image_id, coalesce(CASE n WHEN 'second_optimize_caption' THEN optimized WHEN 'spatial_caption' THEN CASE WHEN len(s) > 2 THEN coalesce(nullif(s[2 + h % (len(s) - 1)], ''), s[2]) ELSE s[1] END WHEN 'coca_caption' THEN general ELSE original END, '') AS caption FROM f""", "v_caption")
def w16(spark, d):
    """Rows with a preferred column and without; short spatial captions."""
    k, p = F.col("image_id") % 7, replace(P, spatial="short")
    preferred = F.when(k == 0, "spatial_caption").when(k == 1, "coca_caption").when(k == 2, "original_caption").when(k == 3, "second_optimize_caption").when(k == 4, "")
    draw = sc.hash_draw(F.lit(P.seed), F.lit("sentence"), F.col("image_id").cast("string"))
    text = ops.training_caption(preferred, ops.chosen_kind(F.col("image_id"), P), *(F.col(c) for c in ("optimized", "spatial", "general", "original", "source")), draw, p)
    return v.captions(spark, d).select("image_id", text.alias("caption"))


@register("T28", f"""WITH p AS (SELECT image_id, string_split(spatial, '.') AS s, {H.format("'42:sentence:' || image_id")} AS h FROM v_caption)
SELECT image_id, CASE WHEN len(s) > 2 THEN coalesce(nullif(s[2 + h % (len(s) - 1)], ''), s[2]) ELSE s[1] END AS sentence FROM p""", "v_caption")
def t28(spark, d):
    draw = sc.hash_draw(F.lit(P.seed), F.lit("sentence"), F.col("image_id").cast("string"))
    return v.captions(spark, d).select("image_id", tx.picked_sentence(F.col("spatial"), draw).alias("sentence"))


@register("T35", r"SELECT doc_id, array_to_string(list_resize(list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS BIGINT)), 16, 0), ',') AS ids FROM documents")
def t35(spark, d):
    """Ids of the offline stand-in for a tokenizer (word lengths), cut or filled to 16."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return v.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(tx.padded(ids, 16, 0), lambda i: i.cast("string")), ",").alias("ids"))


# Status rows.
@register("A13", "SELECT status, count(*) AS n FROM v_status GROUP BY status", "v_status")
def a13(spark, d):
    return v.status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@register("P04", "SELECT image_id, CASE WHEN general IS NULL THEN 'fail' WHEN optimized = '' THEN 'skip' WHEN spatial <> '' THEN 'skip' ELSE 'run' END AS state FROM v_caption", "v_caption")
def p04(spark, d):
    """Row states: unreadable, nothing to do, already done, to run."""
    state = F.when(F.col("general").isNull(), "fail").when(F.col("optimized") == "", "skip").when(F.col("spatial") != "", "skip").otherwise("run")
    return v.captions(spark, d).select("image_id", state.alias("state"))


@register("W06", "SELECT event_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM v_status WHERE status = 'success') WHERE k % 10 = 0", "v_status")
def w06(spark, d):
    k = F.row_number().over(W.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.status(spark, d).filter("status = 'success'").withColumn("k", k).filter("k % 10 = 0").select("event_id")


@register("G19", "SELECT user_id, round(100e0 * count(*) FILTER (status = 'success') / count(*), 6) AS percent, round(count(*) FILTER (status = 'success') / nullif(sum(value), 0), 6) AS per_second, round((count(*) - count(*) FILTER (status = 'success')) * sum(value) / nullif(count(*) FILTER (status = 'success'), 0), 4) AS eta FROM v_status GROUP BY user_id", "v_status")
def g19(spark, d):
    done, n, s = F.count_if(F.col("status") == "success"), F.count("*"), F.sum("value")
    return v.status(spark, d).groupBy("user_id").agg(F.round(F.try_divide(100.0 * done, n), 6).alias("percent"), F.round(F.try_divide(done, s), 6).alias("per_second"), F.round(F.try_divide((n - done) * s, done), 4).alias("eta"))


@register("R03", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def r03(spark, d):
    """Only documents without an output yet; O05 is the same anti-join before inference."""
    return v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("T25", "SELECT event_id, CASE WHEN s < 60 THEN printf('%.1f seconds', s) WHEN s < 3600 THEN printf('%.1f minutes', s / 60) ELSE printf('%.2f hours', s / 3600) END AS took FROM (SELECT event_id, CAST(event_id * 60 AS DOUBLE) / 8 AS s FROM v_status)", "v_status")
def t25(spark, d):
    return v.status(spark, d).select("event_id", tx.duration((F.col("event_id") * 60).cast("double") / 8).alias("took"))


@register("W05", "SELECT doc_id, CAST((row_number() OVER (ORDER BY source, doc_id) - 1) % 4 AS INTEGER) AS worker FROM documents")
def w05(spark, d):
    return ops.round_robin(v.table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], 4).select("doc_id", "worker")


CKPT = "ck AS (SELECT user_id, 'checkpoint-' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id * 100 AS VARCHAR) END AS name FROM events)"


def checkpoints(spark, d):
    suffix = F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("event_id") * 100).cast("string"))
    return v.table(spark, d, "events").select("user_id", F.concat(F.lit("checkpoint-"), suffix).alias("name")).withColumn("step", F.split_part("name", F.lit("-"), F.lit(2)).try_cast("bigint"))


@register("P11", f"WITH {CKPT} SELECT count(*) AS bad FROM ck WHERE try_cast(split_part(name, '-', 2) AS BIGINT) IS NULL")
def p11(spark, d):
    return checkpoints(spark, d).filter("step IS NULL").agg(F.count("*").alias("bad"))


@register("W07", f"WITH {CKPT} SELECT user_id, max(try_cast(split_part(name, '-', 2) AS BIGINT)) AS step FROM ck WHERE name <> 'checkpoint-x' GROUP BY user_id")
def w07(spark, d):
    return checkpoints(spark, d).filter("step IS NOT NULL").groupBy("user_id").agg(F.max_by("step", "step").alias("step"))


@register("W08", f"WITH {CKPT}, s AS (SELECT user_id, CAST(split_part(name, '-', 2) AS BIGINT) AS step FROM ck WHERE name <> 'checkpoint-x') SELECT user_id, step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM s) WHERE k <= n - 5 + 1")
def w08(spark, d):
    return ops.keep_newest(checkpoints(spark, d).filter("step IS NOT NULL"), "user_id", "step", 5).filter("delete").select("user_id", "step")


@register("T16", "SELECT doc_id, TRY_CAST(regexp_extract(CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'img_' || doc_id WHEN 2 THEN doc_id || '-2' ELSE CAST(doc_id AS VARCHAR) END || '_expanded.json', '^[0-9]+') AS INTEGER) AS index FROM documents")
def t16(spark, d):
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    stem = F.when(k == 0, "none").when(k == 1, F.concat(F.lit("img_"), n)).when(k == 2, F.concat(n, F.lit("-2"))).otherwise(n)
    name = F.concat(stem, F.lit("_expanded.json"))
    return v.table(spark, d, "documents").select("doc_id", tx.index_of_file(name).alias("index"))


@register("T26", "SELECT doc_id, printf('sentence_%03d_image_%d.png', doc_id, doc_id % 3) AS name FROM documents")
def t26(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.generated_name(F.col("doc_id"), F.col("doc_id") % 3).alias("name"))


@register("T27", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'stable_diffusion' WHEN 1 THEN 'PixArt-alpha' WHEN 2 THEN 'flux' ELSE 'stable_diffusion' END AS type FROM part")
def t27(spark, d):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, "/m/PixArt-Sigma").when(k == 1, "/m/PixArt-Alpha-512").when(k == 2, "/pixart-alpha/FLUX.1").otherwise("/flux/sd-xl")
    return v.table(spark, d, "part").select("p_partkey", tx.model_type(path).alias("type"))


# Manifests.
@register("A14", "SELECT split, sum(size) AS total, count(*) AS files FROM v_manifest GROUP BY split", "v_manifest")
def a14(spark, d):
    return v.manifest(spark, d).groupBy("split").agg(F.sum("size").alias("total"), F.count("file").alias("files"))


@register("P10", "SELECT split, sum(size) AS total FROM v_manifest WHERE CAST(split_part(file, '.', 1) AS BIGINT) BETWEEN 10 AND 500 GROUP BY split", "v_manifest")
def p10(spark, d):
    bounds = tx.shard_range(F.lit("data/{10..500}.tar"))
    rows = v.manifest(spark, d).withColumn("n", F.regexp_extract("file", r"(\d+)", 1).try_cast("bigint")).withColumn("r", bounds)
    return rows.filter(F.col("n").between(F.col("r.start"), F.col("r.end"))).groupBy("split").agg(F.sum("size").alias("total"))


PATTERN_FILES = 500


@register("T29", f"""WITH n AS (SELECT split, split_part(file, '.', 1) AS stem FROM v_manifest), o AS (SELECT *, (row_number() OVER (ORDER BY split, stem) - 1) // {PATTERN_FILES} AS part FROM n)
SELECT split, part, '{{' || string_agg(stem, ',' ORDER BY stem) || '}}.tar' AS pattern FROM o GROUP BY split, part""", "v_manifest")
def t29(spark, d):
    """Patterns of up to PATTERN_FILES files of a split; a reader takes a list of patterns."""
    from ..operators.ordering import numbered

    named = v.manifest(spark, d).select("split", F.split_part("file", F.lit("."), F.lit(1)).alias("stem"))
    parts = numbered(named, ["split", "stem"], "nth").withColumn("part", F.expr(f"nth div {PATTERN_FILES}"))
    stems = F.sort_array(F.collect_list("stem"))
    return parts.groupBy("split", "part").agg(stems.alias("stems")).select("split", "part", tx.shard_pattern(F.col("stems"), F.lit("tar")).alias("pattern"))
