"""Queries on phrases and on model answers."""

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from ..operators import keywords as kw
from . import views as v
from .registry import register

A = "v_answers"


def quoted(values):
    return ", ".join("'" + x + "'" for x in values)


EXCLUDED = quoted(lex.POSITION_WORDS + lex.ABSTRACT_WORDS + lex.BODY_PARTS + lex.PREPOSITIONS + lex.DESCRIPTORS)
NOUNS = r"list_filter(regexp_split_to_array(phrase, '\s+'), lambda w: w <> '')"


SPOKEN = r"SELECT DISTINCT unnest(regexp_split_to_array(lower(phrase), '\s+')) AS word FROM v_phrase"


def spoken(spark, d):
    """Each word of the phrases once."""
    return v.phrases(spark, d).select(F.explode(F.split(F.lower("phrase"), r"\s+")).alias("word")).distinct()


@register("T04", f"WITH s AS ({SPOKEN}) SELECT word, word IN ({EXCLUDED}) AS excluded FROM s WHERE word <> ''", "v_phrase")
def t04(spark, d):
    """Words of the phrases, and whether the lexicon, the union of its five sets, has them."""
    return spoken(spark, d).filter("word <> ''").select("word", F.array_contains(tx.exclusion_lexicon(), F.col("word")).alias("excluded"))


@register("U02", f"WITH s AS ({SPOKEN}) SELECT word FROM s WHERE word IN ({quoted(lex.POSITION_WORDS)}) UNION SELECT word FROM s WHERE word IN ({quoted(lex.PREPOSITIONS)})", "v_phrase")
def u02(spark, d):
    """Words of the phrases that are in either of two sets."""
    a, b = (spoken(spark, d).filter(F.array_contains(tx.words(w), F.col("word"))) for w in (lex.POSITION_WORDS, lex.PREPOSITIONS))
    return a.union(b).distinct()


@register("T03", rf"""WITH w AS (SELECT image_id, pos, lower(phrase) AS p, list_filter(regexp_split_to_array(lower(phrase), '\s+'), lambda x: x <> '') AS ws FROM v_phrase)
SELECT image_id, pos FROM w WHERE NOT (len(list_filter(ws, lambda x: x NOT IN ({EXCLUDED}))) = 0 OR p IN ({quoted(lex.PLACE_PHRASES)}) OR (ws[1] IN ('in', 'on', 'at', 'by') AND len(ws) <= 2)
 OR (len(ws) <= 3 AND list_contains(ws, 'being') AND list_has_any(ws, ['on', 'in', 'at'])))""", "v_phrase")
def t03(spark, d):
    return v.phrases(spark, d).filter(tx.is_object_phrase(F.col("phrase"))).select("image_id", "pos")


@register("O06", rf"""WITH w AS (SELECT image_id, list_filter(regexp_split_to_array(lower(phrase), '\s+'), lambda x: x <> '') AS ws, lower(phrase) AS p FROM v_phrase)
SELECT image_id, count(*) AS sent_to_model FROM w WHERE NOT (len(list_filter(ws, lambda x: x NOT IN ({EXCLUDED}))) = 0 OR p IN ({quoted(lex.PLACE_PHRASES)}) OR (ws[1] IN ('in', 'on', 'at', 'by') AND len(ws) <= 2)
 OR (len(ws) <= 3 AND list_contains(ws, 'being') AND list_has_any(ws, ['on', 'in', 'at']))) GROUP BY image_id""", "v_phrase")
def o06(spark, d):
    """Cheap rules run before the model sees a phrase."""
    return v.phrases(spark, d).filter(tx.is_object_phrase(F.col("phrase"))).groupBy("image_id").agg(F.count("*").alias("sent_to_model"))


@register("T05", f"SELECT image_id, pos FROM v_phrase WHERE split_part(lower(phrase), ' ', -1) NOT IN ({quoted(lex.BLOCKED_ROOTS)})", "v_phrase")
def t05(spark, d):
    return v.phrases(spark, d).filter(~kw.last_word(F.col("phrase")).isin(lex.BLOCKED_ROOTS)).select("image_id", "pos")


def listed(spark, d):
    rows = v.phrases(spark, d)
    return kw.as_list(rows, "image_id", "phrase", "pos")


@register("W04", "SELECT image_id, string_agg(k || '. ' || phrase, chr(10) ORDER BY k) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS k FROM v_phrase) GROUP BY image_id", "v_phrase")
def w04(spark, d):
    return listed(spark, d).select("image_id", tx.numbered(F.col("phrase")).alias("lines"))


@register("T11", r"""SELECT image_id, '<s>[INST] Answer yes or no for each line: does it name a thing that can be seen and boxed?' || chr(10) || string_agg(k || '. ' || phrase, chr(10) ORDER BY k) || chr(10) || '[/INST]</s>' AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS k FROM v_phrase) GROUP BY image_id""", "v_phrase")
def t11(spark, d):
    return listed(spark, d).select("image_id", tx.yes_no_prompt(F.col("phrase")).alias("prompt"))


@register("A18", f"SELECT image_id, lower({NOUNS}[-1]) AS core, min(pos) AS pos FROM v_phrase GROUP BY ALL", "v_phrase")
def a18(spark, d):
    return kw.first_of_each(v.phrases(spark, d).withColumn("core", tx.core_noun(F.col("phrase"))), "image_id", "core", "pos").select("image_id", "core", "pos")


@register("A19", "SELECT image_id, string_agg(p, '|' ORDER BY p) AS phrases FROM (SELECT DISTINCT image_id, lower(phrase) AS p FROM v_phrase) GROUP BY image_id", "v_phrase")
def a19(spark, d):
    return listed(spark, d).select("image_id", F.array_join(kw.distinct_lower(F.col("phrase")), "|").alias("phrases"))


@register("P02", "SELECT image_id, count(*) AS n FROM v_phrase WHERE phrase LIKE 'Stack%' GROUP BY image_id", "v_phrase")
def p02(spark, d):
    lists = v.phrases(spark, d).groupBy("image_id").agg(F.filter(F.collect_list("phrase"), lambda p: p.startswith("Stack")).alias("keywords"))
    return lists.filter(F.size("keywords") > 0).select("image_id", F.size("keywords").cast("long").alias("n"))


@register("U01", "SELECT image_id, pos, phrase FROM v_phrase UNION ALL SELECT image_id, pos, 'pile of ' || phrase FROM v_phrase", "v_phrase")
def u01(spark, d):
    p = v.phrases(spark, d)
    return p.unionByName(p.withColumn("phrase", F.concat(F.lit("pile of "), "phrase")))


@register("W17", "SELECT image_id, pos, CAST((row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1) // 4 AS INTEGER) AS batch FROM v_phrase", "v_phrase")
def w17(spark, d):
    return kw.micro_batches(v.phrases(spark, d), "image_id", 4).select("image_id", "pos", "batch")


@register("F13", "SELECT image_id, l[1] AS a, l[3] AS b FROM (SELECT image_id, list(phrase ORDER BY pos) AS l FROM v_phrase GROUP BY image_id)", "v_phrase")
def f13(spark, d):
    picked = kw.looked_up(F.array(F.lit(0), F.lit(2)), F.col("phrase"))
    return listed(spark, d).select("image_id", picked.alias("p")).select("image_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


@register("F16", f"SELECT image_id, pos, phrase, lower({NOUNS}[-1]) AS core FROM v_phrase", "v_phrase")
def f16(spark, d):
    """Lists zipped by position."""
    lists = v.phrases(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("pos", "phrase"))).alias("x"))
    zipped = F.arrays_zip(F.transform("x", lambda e: e["pos"]).alias("pos"), F.transform("x", lambda e: e["phrase"]).alias("phrase"), F.transform("x", lambda e: tx.core_noun(e["phrase"])).alias("core"))
    return lists.select("image_id", F.explode(zipped).alias("z")).select("image_id", "z.pos", "z.phrase", "z.core")


@register("T12", "SELECT conv_id, turn, trim(CASE WHEN contains(text, '[/INST]') THEN split_part(text, '[/INST]', 2) WHEN contains(text, 'ok ') THEN split_part(text, 'ok ', -1) ELSE right(text, 500) END) AS answer FROM v_answers", A)
def t12(spark, d):
    return v.answers(spark, d).select("conv_id", "turn", tx.answer_part(F.col("text"), F.lit("ok ")).alias("answer"))


@register("T13", r"""WITH m AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '(\d+)[.:)]?\s*(?:yes|Yes|YES)', 1), lambda x: CAST(x AS INT) - 1), lambda i: i >= 0 AND i < 3) AS found, string_split(text, chr(10)) AS ls FROM v_answers)
SELECT conv_id, turn, array_to_string(CASE WHEN len(found) > 0 THEN found ELSE list_filter([0, 1, 2], lambda i: i < len(ls) AND contains(lower(ls[i + 1]), 'yes')) END, ',') AS yes FROM m""", A)
def t13(spark, d):
    return v.answers(spark, d).select("conv_id", "turn", F.array_join(F.transform(tx.yes_indices(F.col("text"), 3), lambda i: i.cast("string")), ",").alias("yes"))


@register("P12", r"SELECT conv_id, turn FROM v_answers WHERE len(list_filter(regexp_extract_all(text, '(\d+)[.:)]?\s*(?:yes|Yes|YES)', 1), lambda x: TRY_CAST(x AS INT) BETWEEN 1 AND 3)) > 0", A)
def p12(spark, d):
    found = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+)[.:)]?\s*(?:yes|Yes|YES)"), F.lit(1)), lambda x: x.try_cast("int") - 1)
    return v.answers(spark, d).filter(F.exists(found, lambda i: (i >= 0) & (i < 3))).select("conv_id", "turn")


@register("T14", "SELECT conv_id, turn, 'Rewrite the description below in one short sentence. Keep every relation of place, but make exact distances vague.' || chr(10) || 'Description: ' || trim(text) || chr(10) || 'Answer:' AS prompt FROM v_answers", A)
def t14(spark, d):
    return v.answers(spark, d).select("conv_id", "turn", tx.simplify_prompt(F.col("text")).alias("prompt"))


@register("T15", """WITH a AS (SELECT conv_id, turn, trim(split_part(trim(split_part(trim(text), 'Note:', 1)), '```', 1)) AS t FROM v_answers),
b AS (SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)), lambda l: l <> '')[1], t) AS t FROM a),
c AS (SELECT conv_id, turn, CASE WHEN starts_with(t, 'Here is the simplified description:') THEN trim(substr(t, 36)) ELSE t END AS t FROM b),
e AS (SELECT conv_id, turn, CASE WHEN starts_with(t, 'Simplified description:') THEN trim(substr(t, 24)) ELSE t END AS t FROM c),
f AS (SELECT conv_id, turn, CASE WHEN starts_with(t, 'Output:') THEN trim(substr(t, 8)) ELSE t END AS t FROM e)
SELECT conv_id, turn, CASE WHEN starts_with(t, 'Result:') THEN trim(substr(t, 8)) ELSE t END AS caption FROM f""", A)
def t15(spark, d):
    return v.answers(spark, d).select("conv_id", "turn", tx.clean_answer(F.col("text")).alias("caption"))


@register("T18", r"""WITH s AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'The assistant ' WHEN 1 THEN 'My Assistant: ' ELSE '' END || text AS text FROM v_answers)
SELECT conv_id, turn, regexp_replace(CASE WHEN contains(text, 'ASSISTANT:') THEN string_split(text, 'ASSISTANT:')[-1] WHEN regexp_matches(text, '(?i)assistant') THEN string_split(text, 'assistant')[-1] ELSE right(text, -3) END, '^\s+|\s+$', '', 'g') AS answer FROM s""", A)
def t18(spark, d):
    k = (F.col("conv_id") + F.col("turn")) % 6
    said = F.concat(F.when(k == 0, "The assistant ").when(k == 1, "My Assistant: ").otherwise(""), F.col("text"))
    return v.answers(spark, d).select("conv_id", "turn", tx.assistant_answer(said, F.lit("abc")).alias("answer"))


@register("T20", r"""WITH j AS (SELECT conv_id, turn, regexp_extract(text, '(?s)\[.*\]') AS body FROM v_answers),
e AS (SELECT conv_id, turn, unnest(from_json(body, '[{"scene":"VARCHAR","objects":["VARCHAR"],"fuzzy_distance":"VARCHAR"}]')) AS s FROM j WHERE json_valid(body))
SELECT conv_id, turn, s.scene AS scene, array_to_string(s.objects, ',') AS objects, s.fuzzy_distance AS fuzzy_distance FROM e""", A)
def t20(spark, d):
    rows = v.answers(spark, d).select("conv_id", "turn", F.explode(tx.json_list(F.col("text"))).alias("s"))
    return rows.select("conv_id", "turn", "s.scene", F.array_join("s.objects", ",").alias("objects"), "s.fuzzy_distance")


@register("T19", "SELECT conv_id, turn, 'Objects:' || chr(10) || text || chr(10) || 'Say which objects touch each other.' AS contact, 'Direction: a' || chr(10) || 'Distance: b' || chr(10) || 'Contact: ' || text || chr(10) || 'Confidence: c' || chr(10) || 'Combine these into one description.' AS synthesis FROM v_answers", A)
def t19(spark, d):
    return v.answers(spark, d).select("conv_id", "turn", tx.relation_prompt("contact", F.col("text")).alias("contact"), tx.synthesis_prompt(F.lit("a"), F.lit("b"), F.col("text"), F.lit("c")).alias("synthesis"))


@register("T33", "SELECT conv_id, turn, 2 AS messages, 'system' AS first_role, text AS content FROM v_answers", A)
def t33(spark, d):
    rows = v.answers(spark, d).select("conv_id", "turn", tx.chat("You describe scenes.", F.col("text")).alias("m"))
    return rows.select("conv_id", "turn", F.size("m").alias("messages"), F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["content"].alias("content"))


@register("T32", """SELECT conv_id, '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' AS json FROM conversations""")
def t32(spark, d):
    return v.table(spark, d, "conversations").select("conv_id", F.to_json(F.struct("conv_id", "turn", "role")).alias("json"))


@register("K05", "SELECT conv_id, turn, trim(translate(text, chr(9) || chr(10), '  ')) AS optimized_caption, CASE WHEN turn % 2 = 0 THEN '' ELSE CAST(turn AS VARCHAR) END AS index FROM v_answers", A)
def k05(spark, d):
    index = F.coalesce(F.when(F.col("turn") % 2 != 0, F.col("turn")).cast("string"), F.lit(""))
    return v.answers(spark, d).select("conv_id", "turn", tx.tsv_safe(F.col("text")).alias("optimized_caption"), index.alias("index"))


# Models: the stand-ins of functions.models, so that the plans run; see the README.
@register("M01", r"SELECT image_id, pos, len(list_filter(regexp_split_to_array(phrase, '\s+'), lambda w: w <> '')) AS words FROM v_phrase", "v_phrase")
def m01(spark, d):
    from ..functions.models import StubTagger, with_model

    rows = with_model(v.phrases(spark, d).withColumnRenamed("phrase", "caption"), StubTagger())
    return rows.select("image_id", "pos", F.size("output").cast("long").alias("words"))


@register("M02", r"SELECT image_id, pos FROM v_phrase WHERE len(regexp_split_to_array(phrase, '\s+')) <= 3", "v_phrase")
def m02(spark, d):
    from ..functions.models import StubVerifier, with_model

    rows = with_model(v.phrases(spark, d).withColumnRenamed("phrase", "caption"), StubVerifier())
    return rows.filter(F.size("output") > 0).select("image_id", "pos")


@register("M04", r"SELECT image_id, pos, unnest(regexp_split_to_array(phrase, '\s+')) AS label, 0.5e0 AS score FROM v_phrase", "v_phrase")
def m04(spark, d):
    from ..functions.models import StubDetector, with_model

    rows = with_model(v.phrases(spark, d).withColumnRenamed("phrase", "caption"), StubDetector())
    return rows.select("image_id", "pos", F.explode("output").alias("b")).select("image_id", "pos", "b.label", "b.score")


@register("M07", "SELECT count(*) AS failed FROM v_phrase WHERE phrase = 'teddy'", "v_phrase")
def m07(spark, d):
    """A row that a model fails on has its error; the others go on."""
    from ..functions.models import StubDetector, with_model

    class Failing(StubDetector):
        def rule(self, value):
            if value == "teddy":
                raise ValueError("no image")
            return super().rule(value)

    rows = with_model(v.phrases(spark, d).withColumnRenamed("phrase", "caption"), Failing())
    return rows.filter("error IS NOT NULL AND size(output) = 0").agg(F.count("*").alias("failed"))


@register("M03", r"SELECT image_id, pos, CASE WHEN phrase = 'teddy' THEN 0 WHEN len(regexp_split_to_array(phrase, '\s+')) <= 3 THEN 1 ELSE 0 END AS objects FROM v_phrase", "v_phrase")
def m03(spark, d):
    """Zero-shot verdicts; a row on which the stage fails has no object."""
    from ..functions.models import StubVerifier, with_model

    class Failing(StubVerifier):
        def rule(self, value):
            if value == "teddy":
                raise ValueError("no classifier")
            return super().rule(value)

    rows = with_model(v.phrases(spark, d).withColumnRenamed("phrase", "caption"), Failing())
    return rows.select("image_id", "pos", F.size("output").alias("objects"))


@register("M05", r"SELECT image_id, string_split(query, ' ')[-1] AS label, count(*) AS boxes FROM (SELECT image_id, unnest(list_distinct(list(phrase))) AS query FROM v_phrase GROUP BY image_id) GROUP BY ALL", "v_phrase")
def m05(spark, d):
    """A detector that is asked a list of queries: each distinct phrase of an image once; the last box of a query has its noun."""
    from ..functions.models import StubDetector, with_model

    queries = v.phrases(spark, d).select("image_id", F.col("phrase").alias("caption")).distinct()
    rows = with_model(queries, StubDetector()).filter(F.size("output") > 0)
    return rows.select("image_id", F.element_at("output", -1)["label"].alias("label")).groupBy("image_id", "label").agg(F.count("*").alias("boxes"))


@register("M06", r"SELECT image_id, pos, CAST(CASE WHEN phrase = 'teddy' THEN 0 WHEN starts_with(phrase, 'Stack') THEN 1 ELSE len(regexp_split_to_array(phrase, '\s+')) END AS INTEGER) AS boxes FROM v_phrase", "v_phrase")
def m06(spark, d):
    """A detector that is tried with simpler parameters when it fails; what it says that is malformed gives no boxes."""
    from ..functions.models import StubDetector, with_fallback, with_model

    class Simpler(StubDetector):
        def rule(self, value):
            def full():
                if value.startswith("Stack"):
                    raise RuntimeError("CUDA error")
                return StubDetector.rule(self, value)

            boxes, way = with_fallback([("full", full), ("simple", lambda: StubDetector.rule(self, value)[:1])])
            return "malformed" if value == "teddy" else boxes

        def predict(self, frames):
            for frame in super().predict(frames):
                frame["output"] = [o if isinstance(o, list) else [] for o in frame["output"]]
                yield frame

    rows = with_model(v.phrases(spark, d).withColumnRenamed("phrase", "caption"), Simpler())
    return rows.select("image_id", "pos", F.size("output").alias("boxes"))


@register("M08", "SELECT conv_id, turn, kind, 'Objects:' || chr(10) || split_part(text || chr(10) || tail, '.', 1) AS said FROM v_answers, (VALUES ('direction', 'Say where each object lies relative to the others.'), ('distance', 'Say how far apart the objects look, in everyday words.'), ('contact', 'Say which objects touch each other.'), ('confidence', 'Say how sure you are of each statement.')) t(kind, tail)", A)
def m08(spark, d):
    """Four prompts for each image, each answered by the stand-in (the prompt's first sentence)."""
    from ..functions.models import StubWriter, with_model

    kinds = ("direction", "distance", "contact", "confidence")
    prompts = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), tx.relation_prompt(k, F.col("text")).alias("caption")) for k in kinds)))
    rows = with_model(v.answers(spark, d).select("conv_id", "turn", prompts.alias("p")).select("conv_id", "turn", "p.*"), StubWriter())
    return rows.select("conv_id", "turn", "kind", F.col("output")[0].alias("said"))


@register("M09", "SELECT conv_id, turn, split_part('Direction: ' || text || chr(10) || 'Distance: near' || chr(10) || 'Contact: none' || chr(10) || 'Confidence: high' || chr(10) || 'Combine these into one description.', '.', 1) AS said FROM v_answers", A)
def m09(spark, d):
    """One description from four, by the stand-in."""
    from ..functions.models import StubWriter, with_model

    prompt = tx.synthesis_prompt(F.col("text"), F.lit("near"), F.lit("none"), F.lit("high"))
    rows = with_model(v.answers(spark, d).select("conv_id", "turn", prompt.alias("caption")), StubWriter())
    return rows.select("conv_id", "turn", F.col("output")[0].alias("said"))


@register("M12", "SELECT doc_id, coalesce(split_part(text, '.', 1), '') AS sentence FROM documents")
def m12(spark, d):
    """A sentence for each prompt, in batches, by the stand-in."""
    from ..functions.models import StubWriter, with_model

    rows = with_model(v.table(spark, d, "documents").select("doc_id", F.col("text").alias("caption")), StubWriter())
    return rows.select("doc_id", F.col("output")[0].alias("sentence"))


@register("M10", "SELECT conv_id, turn, split_part(text, '.', 1) AS caption FROM v_answers", A)
def m10(spark, d):
    from ..functions.models import StubWriter, with_model

    rows = with_model(v.answers(spark, d).withColumnRenamed("text", "caption"), StubWriter())
    return rows.select("conv_id", "turn", F.col("output")[0].alias("caption"))
