"""Views over the given tables that stand in for images, captions and scores: a DataFrame for Spark and SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    w = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x1, y1, q = (F.col("l_partkey") % 4) * 2.0, (F.col("l_suppkey") % 4) * 2.0, F.col("l_quantity").cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 3).alias("detector"), F.row_number().over(w).cast("long").alias("box_id"),
        F.col("p_name").alias("label"), F.substring_index("p_name", " ", -1).alias("core"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20.0 + (q % 4) * 4).alias("x2"), (y1 + 20.0 + (q % 3) * 4).alias("y2"),
        (F.lit(0.2) + (cents % 800) / 1000.0).alias("score"),
    )


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    w = W.Window.partitionBy("o_orderpriority", "o_custkey").orderBy("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    flag = lambda m: F.when(k % m != 0, 1.0).otherwise(0.0)
    return o.select(
        F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("sentence_idx"), F.row_number().over(w).alias("image_idx"), k.alias("image_id"),
        flag(2).alias("quantity"), flag(3).alias("category"), flag(5).alias("direction"), F.when(k % 11 != 0, flag(7)).alias("distance"), flag(13).alias("scene"),
        F.when(k % 17 != 0, F.lit(1.4) + (cents % 121) / 100.0).alias("clip_score"), F.when(k % 19 == 0, F.lit("no image")).alias("error"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    spaced = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("sentence_idx"), spaced.alias("term"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with a level; those of other first words have none."""
    first = F.substring_index("p_name", " ", 1)
    level = F.when(first.isin("small", "hot"), "L1").when(first.isin("red", "blue"), "L2").when(first.isin("large", "old"), "L3")
    return table(spark, sf_dir, "part").select(F.lower("p_name").alias("key"), level.alias("level")).filter("level IS NOT NULL").distinct()


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers with the dressing that the parsers meet."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    k, t = F.col("conv_id") + F.col("turn"), F.col("text")
    dressed = (
        F.when(k % 6 == 0, F.concat(F.lit("Output: "), t))
        .when(k % 6 == 1, F.concat(F.lit("Result:\n"), t, F.lit("\nNote: done")))
        .when(k % 6 == 2, F.concat(F.lit("1. yes\n2) no\n3: Yes "), t))
        .when(k % 6 == 3, F.concat(F.lit("ask [/INST] sure, yes\nno ```x``` "), t))
        .when(k % 6 == 4, F.concat(F.lit("USER: q ASSISTANT: "), t))
        .otherwise(F.concat(F.lit('ok [{"scene":"room","objects":["cup","dog"],"direction":"left","fuzzy_distance":"near","sentence":"x"}] bye '), F.lit("")))
    )
    return c.select("conv_id", "turn", dressed.alias("text"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k, t = F.col("doc_id"), F.col("text")
    return d.select(
        k.alias("image_id"), F.col("source"), F.when(k % 5 == 0, "").otherwise(t).alias("spatial"),
        F.when(k % 7 != 0, F.concat(F.lit("the  cat's\t"), t)).alias("general"), F.when(k % 3 == 0, "").otherwise(F.concat(t, F.lit(" they're "))).alias("optimized"),
        F.when(k % 2 == 0, F.concat(F.lit("original "), t)).alias("original"),
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate phrases of ten parts an image: part names with rules' cases mixed in."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    phrase = (
        F.when(k % 9 == 0, F.concat(F.lit("Stack of "), n)).when(k % 9 == 1, F.lit("on left")).when(k % 9 == 2, F.lit("next to")).when(k % 9 == 3, F.concat(F.lit("tall "), n))
        .when(k % 9 == 4, F.lit("dog being on")).when(k % 9 == 5, F.lit("teddy")).when(k % 9 == 6, F.upper(n)).otherwise(n)
    )
    return p.select(F.expr("p_partkey div 10").alias("image_id"), k.alias("pos"), phrase.alias("phrase"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").otherwise("success")
    return e.select("event_id", "ts", "user_id", kind.alias("status"), "value")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".tar")).alias("file"), split.alias("split"), F.col("n_chars").alias("size"))


def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of each image (vec_id) with three prompts (vec_id 0, 1, 2): a bounded set of anchors."""
    from ..functions.scoring import dot

    e = table(spark, sf_dir, "embeddings")
    anchors = e.filter("vec_id < 3").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda a: a["embedding"]).alias("anchors"))
    logits = F.transform("anchors", lambda a: F.round(dot(a, F.col("embedding")) * 10, 6))
    return e.join(F.broadcast(anchors)).select(F.col("vec_id").alias("image_id"), "label", logits.alias("logits"))


def half_up(x: str, digits: int) -> str:
    """SQL for functions.scoring.rounded."""
    return f"CAST(round(CAST({x} AS DECIMAL(18, 9)), {digits}) AS DOUBLE)"


_FINAL = "(0.6e0 * (hard_score / 5e0) + 0.4e0 * ((soft_score - 1e0) / 4e0))"
SQL = {
    "v_boxes": """SELECT l_orderkey AS image_id, l_linenumber % 3 AS detector,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS box_id, p_name AS label, split_part(p_name, ' ', -1) AS core,
 (l_partkey % 4) * 2e0 AS x1, (l_suppkey % 4) * 2e0 AS y1, (l_partkey % 4) * 2e0 + 20e0 + (CAST(l_quantity AS INT) % 4) * 4 AS x2,
 (l_suppkey % 4) * 2e0 + 20e0 + (CAST(l_quantity AS INT) % 3) * 4 AS y2, 0.2e0 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 800) / 1000e0 AS score
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_eval": """SELECT o_orderpriority AS model, o_custkey AS sentence_idx, CAST(row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS INT) AS image_idx,
 o_orderkey AS image_id, CASE WHEN o_orderkey % 2 <> 0 THEN 1e0 ELSE 0e0 END AS quantity, CASE WHEN o_orderkey % 3 <> 0 THEN 1e0 ELSE 0e0 END AS category,
 CASE WHEN o_orderkey % 5 <> 0 THEN 1e0 ELSE 0e0 END AS direction, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 7 <> 0 THEN 1e0 ELSE 0e0 END END AS distance,
 CASE WHEN o_orderkey % 13 <> 0 THEN 1e0 ELSE 0e0 END AS scene, CASE WHEN o_orderkey % 17 <> 0 THEN 1.4e0 + (CAST(round(o_totalprice * 100) AS BIGINT) % 121) / 100e0 END AS clip_score,
 CASE WHEN o_orderkey % 19 = 0 THEN 'no image' END AS error FROM orders""",
    "v_scored": """SELECT *, quantity + category + direction + coalesce(distance, 0e0) + scene AS hard_score, coalesce(clip_score, 0e0) AS soft_score FROM v_eval""",
    "v_composite": f"""SELECT *, {half_up("hard_score / 5e0", 4)} AS s_hard_normalized, {half_up("(soft_score - 1e0) / 4e0", 4)} AS s_soft_normalized,
 {half_up(_FINAL, 4)} AS score_final, {half_up(_FINAL + " * 15e0", 2)} AS score_final_scaled FROM v_scored""",
    "v_terms": """SELECT p_partkey AS sentence_idx, CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) || ' ' WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS term FROM part""",
    "v_map": """SELECT DISTINCT lower(p_name) AS key, CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'hot') THEN 'L1' WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN 'L2' ELSE 'L3' END AS level
 FROM part WHERE split_part(p_name, ' ', 1) IN ('small', 'hot', 'red', 'blue', 'large', 'old')""",
    "v_answers": """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Output: ' || t WHEN 1 THEN 'Result:' || chr(10) || t || chr(10) || 'Note: done'
 WHEN 2 THEN '1. yes' || chr(10) || '2) no' || chr(10) || '3: Yes ' || t WHEN 3 THEN 'ask [/INST] sure, yes' || chr(10) || 'no ```x``` ' || t WHEN 4 THEN 'USER: q ASSISTANT: ' || t
 ELSE 'ok [{"scene":"room","objects":["cup","dog"],"direction":"left","fuzzy_distance":"near","sentence":"x"}] bye ' END AS text
 FROM (SELECT *, text AS t FROM conversations WHERE role = 'assistant')""",
    "v_caption": """SELECT doc_id AS image_id, source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS spatial,
 CASE WHEN doc_id % 7 <> 0 THEN 'the  cat''s' || chr(9) || text END AS general, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text || ' they''re ' END AS optimized,
 CASE WHEN doc_id % 2 = 0 THEN 'original ' || text END AS original FROM documents""",
    "v_phrase": """SELECT p_partkey // 10 AS image_id, p_partkey AS pos, CASE p_partkey % 9 WHEN 0 THEN 'Stack of ' || p_name WHEN 1 THEN 'on left' WHEN 2 THEN 'next to' WHEN 3 THEN 'tall ' || p_name
 WHEN 4 THEN 'dog being on' WHEN 5 THEN 'teddy' WHEN 6 THEN upper(p_name) ELSE p_name END AS phrase FROM part""",
    "v_status": """SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' ELSE 'success' END AS status, value FROM events""",
    "v_manifest": """SELECT CAST(doc_id AS VARCHAR) || '.tar' AS file, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, n_chars AS size FROM documents""",
    "v_clip": """SELECT e.vec_id AS image_id, e.label, [round(list_sum(list_transform(list_zip(CAST(a0.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: z[1] * z[2])) * 10, 6),
 round(list_sum(list_transform(list_zip(CAST(a1.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: z[1] * z[2])) * 10, 6),
 round(list_sum(list_transform(list_zip(CAST(a2.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: z[1] * z[2])) * 10, 6)] AS logits
 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) a0, (SELECT embedding FROM embeddings WHERE vec_id = 1) a1, (SELECT embedding FROM embeddings WHERE vec_id = 2) a2""",
}
NEEDS = {"v_scored": ["v_eval"], "v_composite": ["v_eval", "v_scored"]}


def with_views(body: str, *names: str) -> str:
    """body as a query with the named views, and those they need, before it."""
    order = list(dict.fromkeys(n for name in names for n in (*NEEDS.get(name, []), name)))
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.lstrip()
    recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
    if not body.startswith("WITH "):
        return f"WITH {views}\n{body}"
    return f"WITH {recursive}{views},\n{body.removeprefix('WITH ').removeprefix('RECURSIVE ')}"
