"""Queries on runs: settings, metrics, reports, fallbacks, streams that resume."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..functions.lexicons import LEVEL_NAMES
from ..operators import reports, runs
from ..operators import scores as ops
from ..sources.shared import new_path
from . import views as v
from .detection_queries import LEVELS_SQL, level_checks
from .registry import register

SETTINGS = """st AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 2 = 0 THEN 'wandb' ELSE 'tensorboard' END AS report_to, CASE WHEN o_orderkey % 3 = 0 THEN 'token' END AS hub_token, CASE o_orderkey % 5 WHEN 0 THEN 'hpu' WHEN 1 THEN NULL ELSE 'cuda' END AS device,
 o_custkey % 2 = 0 AS xf, o_custkey % 7 = 0 AS tf32, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 3 = 0 END AS gc, o_custkey % 13 = 0 AS push, CASE WHEN o_orderkey % 7 = 0 THEN 'gaudi' END AS gaudi, CASE WHEN o_orderkey % 17 > 0 THEN o_orderkey % 4 END AS warm FROM orders)"""


@register("P13", f"""WITH {SETTINGS} SELECT run, concat_ws('; ', CASE WHEN report_to = 'wandb' AND hub_token IS NOT NULL THEN 'wandb with hub_token' END,
 CASE WHEN device = 'hpu' AND xf THEN 'enable_xformers_memory_efficient_attention on hpu' END, CASE WHEN device = 'hpu' AND tf32 THEN 'allow_tf32 on hpu' END, CASE WHEN device = 'hpu' AND gc THEN 'gradient_checkpointing on hpu' END, CASE WHEN device = 'hpu' AND push THEN 'push_to_hub on hpu' END,
 CASE WHEN device IS DISTINCT FROM 'hpu' AND gaudi IS NOT NULL THEN 'gaudi_config_name without hpu' END, CASE WHEN device IS DISTINCT FROM 'hpu' AND coalesce(warm, 0) <> 0 THEN 'throughput_warmup_steps without hpu' END) AS problems FROM st""")
def p13(spark, d):
    """What speaks against starting each of a table of runs."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = {
        "report_to": F.when(k % 2 == 0, "wandb").otherwise("tensorboard"), "hub_token": F.when(k % 3 == 0, "token"), "device": F.when(k % 5 == 0, "hpu").when(k % 5 != 1, "cuda"),
        "enable_xformers_memory_efficient_attention": c % 2 == 0, "allow_tf32": c % 7 == 0, "gradient_checkpointing": F.when(c % 11 > 0, c % 3 == 0), "push_to_hub": c % 13 == 0,
        "gaudi_config_name": F.when(k % 7 == 0, "gaudi"), "throughput_warmup_steps": F.when(k % 17 > 0, k % 4),
    }
    return v.table(spark, d, "orders").select(k.alias("run"), F.array_join(runs.problems(of), "; ").alias("problems"))


@register("K19", "SELECT o_orderkey AS run, round(15000e0 * 32 / (o_custkey % 1000 + 1), 4) AS train_samples_per_second, CAST(o_custkey % 1000 + 1 AS DOUBLE) AS train_runtime FROM orders")
def k19(spark, d):
    seconds = (F.col("o_custkey") % 1000 + 1).cast("double")
    return v.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), runs.speed(F.lit(15000.0), F.lit(32), seconds).alias("m")).select("run", "m.*")


PC = lambda a, b: f"printf('%.2f', round(100 * coalesce(round({a} / nullif({b}, 0), 4), 0), 2)) || '%'"
PAD = lambda c, n: f"rpad({c}, CAST(greatest(length({c}), {n}) AS INT), ' ')"
EQ, DASH = "repeat('=', 80)", "repeat('-', 80)"


@register("K14", f"""WITH {LEVELS_SQL}, s AS (SELECT 'fuzzy-model-with-a-name-of-forty-characters-' || model AS model, count(*) FILTER (contact_expected) AS t1, count(*) FILTER (contact_expected AND pass_contact_check) AS c1, count(*) FILTER (predicted_level <> 'Unknown') AS t, count(*) FILTER (predicted_level = level) AS c,
 count(*) FILTER (level = 'L1' AND predicted_level <> 'Unknown') AS n1, count(*) FILTER (level = 'L2' AND predicted_level <> 'Unknown') AS n2, count(*) FILTER (level = 'L3' AND predicted_level <> 'Unknown') AS n3,
 count(*) FILTER (level = 'L1' AND predicted_level = 'L1') AS k1, count(*) FILTER (level = 'L2' AND predicted_level = 'L2') AS k2, count(*) FILTER (level = 'L3' AND predicted_level = 'L3') AS k3 FROM lv GROUP BY model),
q AS (SELECT model, t1, c1, t, c, {PC("c1", "t1")} AS pc, {PC("c", "t")} AS pl, {PC("k1", "n1")} AS p1, {PC("k2", "n2")} AS p2, {PC("k3", "n3")} AS p3 FROM s),
l AS (SELECT 0 AS part, NULL AS model, [{EQ}, 'Fuzzy Term Level-based Analysis Report', {EQ}, '', 'Level Definitions:', {DASH}, '  L1: Contact & Pressure', '  L2: Grazing & Zero-Gap', '  L3: Proximity & Reach', '', {EQ}, 'Model Comparison', {EQ}, '', 'Model               L1 Contact     Level Acc      L1 Acc      L2 Acc      L3 Acc      ', {DASH}] AS texts
 UNION ALL SELECT 1, model, [{PAD("model", 20)} || {PAD("pc", 15)} || {PAD("pl", 15)} || {PAD("p1", 12)} || {PAD("p2", 12)} || {PAD("p3", 12)}] FROM q
 UNION ALL SELECT 2, model, ['', '', {EQ}, 'Detailed Analysis: ' || model, {EQ}, '', 'Contact Detection (L1 Specific):', repeat('-', 40), '  Total L1 images: ' || t1, '  Correctly detected: ' || c1, '  Accuracy: ' || pc, '', 'Level Prediction:', repeat('-', 40), '  Total predictions: ' || t, '  Correct predictions: ' || c, '  Overall accuracy: ' || pl, '',
 'Per-Level Accuracy:', '  L1 (Contact & Pressure): ' || p1, '  L2 (Grazing & Zero-Gap): ' || p2, '  L3 (Proximity & Reach): ' || p3] FROM q)
SELECT part, model, CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS line, unnest(texts) AS text FROM l""", "v_boxes")
def k14(spark, d):
    """The whole report on levels, of models with long names."""
    checks = level_checks(spark, d).withColumn("model", F.concat(F.lit("fuzzy-model-with-a-name-of-forty-characters-"), "model"))
    return reports.level_report(ops.contact_statistics(checks), ops.per_level_accuracy(checks), LEVEL_NAMES)


@register("K16", f"WITH {LEVELS_SQL} SELECT model, 'L1 contact' AS series, round(count(*) FILTER (contact_expected AND pass_contact_check) / nullif(count(*) FILTER (contact_expected), 0), 4) AS value FROM lv GROUP BY model UNION ALL SELECT model, level, round(count(*) FILTER (predicted_level = level) / count(*), 4) FROM lv WHERE predicted_level <> 'Unknown' GROUP BY model, level", "v_boxes")
def k16(spark, d):
    """Data of the bars of contact and of levels (the heat map's are A07's); drawing is left to the reader."""
    checks = level_checks(spark, d)
    contact = ops.contact_statistics(checks).select("model", F.lit("L1 contact").alias("series"), F.col("l1_accuracy").alias("value"))
    return contact.unionByName(ops.per_level_accuracy(checks).select("model", F.col("level").alias("series"), F.col("accuracy").alias("value")))


@register("M11", r"""WITH w AS (SELECT image_id, pos, phrase, string_split(lower(phrase), ' ') AS ws FROM v_phrase),
a AS (SELECT *, CASE WHEN list_contains(ws, 'to') THEN NULL WHEN list_contains(ws, 'tall') THEN CASE WHEN list_contains(ws, 'brass') THEN NULL ELSE 'cpu' END WHEN list_contains(ws, 'stack') THEN 'reload' WHEN list_contains(ws, 'left') THEN 'greedy' ELSE 'sample' END AS attempt FROM w)
SELECT image_id, pos, attempt, CASE WHEN attempt IS NOT NULL THEN ws[-1] END AS answer FROM a""", "v_phrase")
def m11(spark, d):
    """The ladder of attempts: what fails without a known cause ends there, what has one goes on to greedy, a reloaded model and the CPU."""
    from ..functions.models import Laddered, with_model

    rows = with_model(v.phrases(spark, d), Laddered())
    return rows.select("image_id", "pos", F.get("output", F.lit(0)).alias("attempt"), F.get("output", F.lit(1)).alias("answer"))


@register("R01", """WITH a AS (SELECT l_orderkey // 8000 AS shard, l_orderkey, l_linenumber, CAST('0x' || substr(md5('42:' || l_orderkey || ':' || l_linenumber), 1, 8) AS BIGINT) AS draw FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM a),
c AS (SELECT *, CASE WHEN i < 1000 THEN i ELSE draw % 1000 END AS slot FROM b),
e AS (SELECT *, lead(i) OVER (PARTITION BY shard, slot ORDER BY i) AS follower FROM c)
SELECT shard, l_orderkey, l_linenumber, CASE WHEN follower IS NOT NULL THEN follower - 1000 ELSE greatest(0, n - 1000) + row_number() OVER (PARTITION BY shard, follower IS NULL ORDER BY draw, l_orderkey, l_linenumber) - 1 END AS place FROM e""")
def r01(spark, d):
    """Lines of shards of 8,000 orders, through a buffer of 1,000 places. In SQL: a row leaves when the next one draws its place."""
    from ..operators.shuffle_buffer import buffered

    rows = v.table(spark, d, "lineitem").select(F.expr("l_orderkey div 8000").alias("shard"), F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return buffered(rows, "shard", ["l_orderkey", "l_linenumber"], "42")


@register("R02", "SELECT count(*) * 6 // 10 AS rows, count(*) * 6 // 10 AS customers, 0 AS strangers FROM customer")
def r02(spark, d):
    """Generate from a stream of requests until there is a row for six in ten customers; the first run is cut off in its third batch."""
    from pyspark.errors import StreamingQueryException

    from ..streaming.generate import generate_until

    source, sink, checkpoint = (new_path(spark, name) for name in ("requests", "generated", "progress"))
    customers = v.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    customers.repartitionByRange(8, "key").write.parquet(source)
    target = customers.count() * 6 // 10
    requests = spark.readStream.schema("key long").option("maxFilesPerTrigger", 1).parquet(source)
    calls = []

    def make(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the model is out of reach")
        return rows.withColumn("sentence", F.concat(F.lit("a cup near "), F.col("key").cast("string")))

    try:
        generate_until(requests, make, ["key"], sink, checkpoint, target)
    except StreamingQueryException:
        generate_until(requests, make, ["key"], sink, checkpoint, target)
    made = spark.read.parquet(sink)
    counts = made.agg(F.count("*").alias("rows"), F.countDistinct("key").alias("customers"))
    strangers = made.join(customers, "key", "left_anti").agg(F.count("*").alias("strangers"))
    return counts.join(strangers)


def _halves(spark, d, folder: str, odd: int) -> None:
    v.table(spark, d, "events").filter(F.col("event_id") % 2 == odd).select("event_id", "event_type").write.mode("append").parquet(folder)


@register("R05", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")
def r05(spark, d):
    """A second run reads only the files that came after the first."""
    from ..streaming.resume import run_on

    source, out, checkpoint = (new_path(spark, name) for name in ("events", "resumed", "progress"))
    for odd in (0, 1):
        _halves(spark, d, source, odd)
        run_on(spark, source, "event_id long, event_type string", out, checkpoint)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@register("R04", "SELECT count(*) AS done, true AS ended FROM events")
def r04(spark, d):
    """Rows of all batches, as the listener was told of them."""
    from ..streaming.resume import Completed, run_on

    source, told = new_path(spark, "events"), Completed()
    for odd in (0, 1):
        _halves(spark, d, source, odd)
    spark.streams.addListener(told)
    try:
        run_on(spark, source, "event_id long, event_type string", new_path(spark, "drained"), new_path(spark, "progress"))
        until = time.time() + 30
        while not told.ended and time.time() < until:  # events arrive a moment after the query ends
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
    return spark.createDataFrame([(sum(n for r in told.rows.values() for n in r), bool(told.ended))], "done long, ended boolean")
