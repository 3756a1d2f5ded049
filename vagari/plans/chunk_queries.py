"""Queries on tags, lemmas and noun chunks of phrases."""

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..operators import chunks
from ..operators import keywords as kw
from . import views as v
from .language_queries import EXCLUDED
from .registry import register


# Tags: words of closed classes, first words of part names as adjectives, other words by their form.
def tag_table(spark, d):
    first = v.table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    closed = chunks.closed_words(spark)
    return closed.unionByName(first.join(closed, "word", "left_anti").select("word", F.lit("ADJ").alias("tag"), F.col("word").alias("lemma")))


def tagged(spark, d, phrases=None, key=("image_id", "pos"), text="phrase"):
    return chunks.tagged(phrases if phrases is not None else v.phrases(spark, d), list(key), text, tag_table(spark, d))


BE = ("is", "are", "was", "were", "been", "being", "am")
CLOSED = ", ".join(f"('{w}', '{tag}', '{'be' if w in BE else w}')" for tag, words in chunks.CLOSED.items() for w in words.split())
TAGS = (
    f"closed(word, tag, lemma) AS (VALUES {CLOSED}),"
    r"""
lexicon AS (SELECT * FROM closed UNION ALL SELECT DISTINCT split_part(p_name, ' ', 1), 'ADJ', split_part(p_name, ' ', 1) FROM part WHERE split_part(p_name, ' ', 1) NOT IN (SELECT word FROM closed)),
split AS (SELECT image_id, pos, phrase, regexp_extract_all(phrase, '''s\b|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]') AS ws FROM texts),
said AS (SELECT image_id, pos, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM split),
formed AS (SELECT s.*, lower(s.word) AS low, coalesce(tag, CASE WHEN s.word = '''s' THEN 'PART' WHEN NOT regexp_matches(s.word, '[\p{L}\p{N}]') THEN 'PUNCT' WHEN regexp_full_match(s.word, '\p{N}+') THEN 'NUM' WHEN ends_with(lower(s.word), 'ly') THEN 'ADV' WHEN regexp_matches(lower(s.word), '.(ing|ed)$') THEN 'VERB' ELSE 'NOUN' END) AS tag, lemma
 FROM said s LEFT JOIN lexicon ON lower(s.word) = lexicon.word),
tok AS (SELECT image_id, pos, i, word, low, tag, coalesce(lemma, CASE WHEN tag <> 'NOUN' THEN low WHEN regexp_matches(low, '[^aeiou]ies$') THEN regexp_replace(low, 'ies$', 'y') WHEN regexp_matches(low, '(s|x|z|ch|sh)es$') THEN regexp_replace(low, 'es$', '') WHEN regexp_matches(low, '[^sui]s$') THEN regexp_replace(low, 's$', '') ELSE low END) AS lemma FROM formed),
lists AS (SELECT t.image_id, t.pos, t.phrase, list({'word': word, 'low': low, 'tag': tag, 'lemma': lemma} ORDER BY i) FILTER (word IS NOT NULL) AS l, arg_max(low, i) FILTER (tag = 'NOUN') AS noun, arg_max(k.lemma, i) FILTER (tag = 'NOUN') AS core, arg_max(k.lemma, i) AS last_lemma, arg_max(tag, i) AS last_tag
 FROM texts t LEFT JOIN tok k ON t.image_id = k.image_id AND t.pos = k.pos GROUP BY t.image_id, t.pos, t.phrase)"""
)
TEXTS = "texts AS (SELECT * FROM v_phrase)"
CONTAINER = rf"(phrase LIKE '% of %' AND regexp_matches(lower(phrase), '^({'|'.join(lex.CONTAINERS)})') AND regexp_matches(lower(phrase), '\w+\s+of\s+\w+'))"


@register("T06", f"WITH {TEXTS}, {TAGS} SELECT image_id, pos FROM lists WHERE last_tag = 'NOUN'", "v_phrase")
def t06(spark, d):
    """Phrases whose last word is a noun by its tag."""
    return tagged(spark, d).filter(chunks.is_noun_phrase(F.col("tokens"))).select("image_id", "pos")


@register("T07", f"WITH {TEXTS}, {TAGS} SELECT image_id, pos, CASE WHEN noun IS NULL OR {CONTAINER} THEN lower(phrase) ELSE noun END AS name FROM lists", "v_phrase")
def t07(spark, d):
    # The container rule needs " of " in the phrase as written; "Stack of" has it.
    return tagged(spark, d).select("image_id", "pos", chunks.object_name(F.col("phrase"), F.col("tokens")).alias("name"))


@register("T08", f"WITH {TEXTS}, {TAGS} SELECT image_id, pos, coalesce(core, replace(lower(phrase), ' ', '')) AS core FROM lists", "v_phrase")
def t08(spark, d):
    return tagged(spark, d).select("image_id", "pos", chunks.core_noun(F.col("phrase"), F.col("tokens")).alias("core"))


LABEL = f"WITH {TEXTS}, {TAGS} SELECT image_id, pos, CASE WHEN core IN ('teddy', 'bear') THEN 'bear' ELSE coalesce(core, replace(lower(phrase), ' ', '_')) END AS label FROM lists"


@register("T09", LABEL, "v_phrase")
def t09(spark, d):
    return tagged(spark, d).select("image_id", "pos", chunks.standard_label(F.col("phrase"), F.col("tokens")).alias("label"))


@register("O02", LABEL, "v_phrase")
def o02(spark, d):
    """Labels are computed once for each distinct phrase."""
    label = lambda p: tagged(spark, d, p, ("phrase",)).select("phrase", chunks.standard_label(F.col("phrase"), F.col("tokens")).alias("label"))
    return kw.once_each(v.phrases(spark, d), "phrase", label).select("image_id", "pos", "label")


@register("A17", f"WITH {TEXTS}, {TAGS} SELECT image_id, last_lemma AS root, arg_max(phrase, len(phrase) * 1000000000 - pos) AS phrase, min(pos) AS first_pos FROM lists WHERE last_lemma IS NOT NULL GROUP BY image_id, last_lemma", "v_phrase")
def a17(spark, d):
    return chunks.longest_by_lemma(tagged(spark, d), "image_id")


CAPTION = "CASE pos % 4 WHEN 0 THEN phrase WHEN 1 THEN 'It holds two ' || phrase || '''s boxes of tea next to a cup of hot water' WHEN 2 THEN 'a pile of ' || phrase || ' and the red' ELSE 'The dog''s bowls stand behind a ' || phrase || ', with them' END"


@register(
    "T02",
    f"WITH texts AS (SELECT image_id, pos, {CAPTION} AS phrase FROM v_phrase), {TAGS},"
    + r"""
letters AS (SELECT image_id, pos, l, list_aggregate(list_transform(l, lambda t: CASE t.tag WHEN 'DET' THEN 'D' WHEN 'ADJ' THEN 'A' WHEN 'NUM' THEN 'A' WHEN 'NOUN' THEN 'N' WHEN 'PART' THEN 'S' WHEN 'PRON' THEN 'P' ELSE 'O' END), 'string_agg', '') AS s FROM lists WHERE l IS NOT NULL),
marked AS (SELECT *, string_split(regexp_replace(s, '(D?A*N+(?:SA*N+)*|P)', '[\1]', 'g'), '[') AS parts FROM letters),
spans AS (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM marked),
begun AS (SELECT image_id, pos, l, k, len(replace(array_to_string(parts[1:k - 1], ''), ']', '')) AS a, len(string_split(parts[k], ']')[1]) AS n FROM spans),
ch AS (SELECT image_id, pos, l, k, a, a + n AS b FROM begun),
nx AS (SELECT *, lead(a) OVER w AS a2, lead(b) OVER w AS b2 FROM ch WINDOW w AS (PARTITION BY image_id, pos ORDER BY k)),
"""
    + f"""words AS (SELECT image_id, pos, k, 0 AS part, array_to_string(list_transform(l[a + 1:b], lambda t: t.word), ' ') AS phrase, l[b].word AS root, l[b].tag AS kind FROM nx WHERE l[b].lemma NOT IN ({EXCLUDED}) AND NOT (b - a = 1 AND l[b].tag = 'PRON')
 UNION ALL SELECT image_id, pos, k, 1, array_to_string(list_transform(l[b:b2], lambda t: t.word), ' '), l[b].word, 'COMPOUND' FROM nx WHERE a2 = b + 1 AND l[b + 1].word = 'of' AND (a = 0 OR l[a].tag <> 'ADP') AND l[b].tag = 'NOUN' AND l[b2].tag = 'NOUN' AND l[b].low NOT IN ({EXCLUDED}) AND l[b2].low NOT IN ({EXCLUDED}))
SELECT image_id, pos, CAST(row_number() OVER (PARTITION BY image_id, pos ORDER BY part, k) - 1 AS INTEGER) AS nth, phrase, root, kind FROM words""",
    "v_phrase",
)
def t02(spark, d):
    """Noun chunks and compounds of captions, by the grammar over tagged tokens."""
    p, k = F.col("phrase"), F.col("pos") % 4
    said = F.when(k == 0, p).when(k == 1, F.concat(F.lit("It holds two "), p, F.lit("'s boxes of tea next to a cup of hot water"))).when(k == 2, F.concat(F.lit("a pile of "), p, F.lit(" and the red"))).otherwise(F.concat(F.lit("The dog's bowls stand behind a "), p, F.lit(", with them")))
    rows = tagged(spark, d, v.phrases(spark, d).withColumn("phrase", said)).withColumn("chunks", chunks.noun_chunks(F.col("tokens")))
    found = rows.select("image_id", "pos", F.posexplode(chunks.candidates(F.col("tokens"), F.col("chunks"))).alias("nth", "c"))
    return found.select("image_id", "pos", "nth", "c.phrase", "c.root", F.col("c.pos").alias("kind"))
