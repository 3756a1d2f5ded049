"""Noun chunks from tagged tokens: T02, T06 to T09 and A17 on tags and lemmas of a joined table.

A tagger gives each word a tag and a lemma. Here both come from a table of words,
which a user fills from a treebank or a model; words that it lacks get them from
their form. Chunks are found by a finite-state grammar, a fold over a text's
tokens. All is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx

# Words of closed classes, by tag; a user's table may have others.
CLOSED = {
    "DET": "a an the this that these those some any each every no both all my your his her its our their another",
    "PRON": "i you he she it we they me him us them who something nothing everything someone anyone mine yours",
    "ADP": "of in on at by with from to for about against between into through during before after above below under over near behind beside beyond inside outside along across around up down off",
    "CONJ": "and or but nor while because",
    "AUX": "is are was were be been being am has have had do does did can could will would may might must shall should",
    "ADV": "not very too also just quite almost there here",
    "NUM": "one two three four five six seven eight nine ten",
}
TOKEN = r"'s\b|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
TOKENS = "array<struct<i:int,word:string,tag:string,lemma:string>>"
NOUN = ["NOUN", "PROPN"]
OUT, OPEN, IN = 0, 1, 2


def closed_words(spark: SparkSession) -> DataFrame:
    """word, tag, lemma of the closed classes."""
    rows = [(w, tag, "be" if w in ("is", "are", "was", "were", "been", "being", "am") else w) for tag, words in CLOSED.items() for w in words.split()]
    return spark.createDataFrame(rows, "word string, tag string, lemma string")


def tag_by_form(word: Column) -> Column:
    """Tag of a word that no table has."""
    return F.when(word == "'s", "PART").when(~word.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(word.rlike(r"^\p{N}+$"), "NUM").when(word.rlike("ly$"), "ADV").when(word.rlike(".(ing|ed)$"), "VERB").otherwise("NOUN")


def lemma_by_form(word: Column, tag: Column) -> Column:
    """Lemma of a lower-case word that no table has: of nouns the singular."""
    one = F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^sui]s$"), F.regexp_replace(word, "s$", ""))
    return F.when(tag.isin(NOUN), F.coalesce(one, word)).otherwise(word)


def tagged(rows: DataFrame, key: list[str], text: str, table: DataFrame, name: str = "tokens") -> DataFrame:
    """rows with their text's tokens: place, word, tag and lemma. key must be unique; table has word (lower case, each once), tag and lemma.

    Each distinct word meets the table once. Null and empty texts have no tokens.
    Every token finds its word, so the left join loses and adds nothing; it keeps
    Spark from broadcasting the tokens, which its estimate takes for a small file.
    The hint does so for the rows, where a filter on tokens makes theirs an inner join.
    """
    said = rows.select(*key, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)).alias("i", "word")).withColumn("low", F.lower("word"))
    words = said.select("low").distinct().join(table.select(F.col("word").alias("low"), "tag", "lemma"), "low", "left")
    tag = F.coalesce("tag", tag_by_form(F.col("low")))
    words = words.select("low", tag.alias("tag"), F.coalesce("lemma", lemma_by_form(F.col("low"), tag)).alias("lemma"))
    met = said.join(words, "low", "left").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "word", "tag", "lemma"))).alias(name))
    return rows.hint("merge").join(met, key, "left").withColumn(name, F.coalesce(name, F.array().cast(TOKENS)))


def noun_chunks(tokens: Column) -> Column:
    """(first, root) places of the chunks, in order; a chunk ends with its root.

    A chunk is an optional determiner, adjectives and numbers, then nouns; a
    possessive after a noun opens the rest of the same chunk; a pronoun is a chunk
    of its own. Determiner and adjectives that no noun follows are none.
    """
    kind = "struct<first:int,root:int>"
    state = lambda s, first, root, out: F.struct(s.cast("int").alias("s"), first.cast("int").alias("first"), root.cast("int").alias("root"), out.alias("out"))
    none = F.lit(-1)
    start = state(F.lit(OUT), none, none, F.array().cast(f"array<{kind}>"))
    chunk = lambda first, root: F.struct(first.cast("int").alias("first"), root.cast("int").alias("root"))

    def step(a: Column, t: Column) -> Column:
        tag, i, s = t["tag"], t["i"], a["s"]
        noun, inner, det, part = tag.isin(NOUN), tag.isin("ADJ", "NUM"), tag == "DET", tag == "PART"
        done = F.when(a["root"] >= 0, F.array_append(a["out"], chunk(a["first"], a["root"]))).otherwise(a["out"])  # what waits is given before another begins
        opened = F.when(noun, state(F.lit(IN), i, i, done)).when(inner | det, state(F.lit(OPEN), i, none, done)).when(tag == "PRON", state(F.lit(OUT), none, none, F.array_append(done, chunk(i, i)))).otherwise(state(F.lit(OUT), none, none, done))
        more = F.when(noun, state(F.lit(IN), a["first"], i, a["out"]))
        return F.when((s == IN) & noun, more).when((s == IN) & part, state(F.lit(OPEN), a["first"], a["root"], a["out"])).when((s == OPEN) & noun, more).when((s == OPEN) & inner, a).otherwise(opened)

    return F.aggregate(tokens, start, step, lambda a: F.when(a["root"] >= 0, F.array_append(a["out"], chunk(a["first"], a["root"]))).otherwise(a["out"]))


def _joined(tokens: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.transform(F.slice(tokens, first + 1, last - first + 1), lambda t: t["word"]), " ")


def candidates(tokens: Column, chunks: Column) -> Column:
    """Phrase, root and pos of the chunks whose root isn't excluded by its lemma and that aren't a lone pronoun, then of "X of Y" compounds of their nouns (pos COMPOUND), whose head is no object of a preposition and neither of whose words is excluded."""
    excluded = tx.exclusion_lexicon()
    at = lambda i: F.get(tokens, i)
    kept = F.filter(chunks, lambda c: ~F.array_contains(excluded, at(c["root"])["lemma"]) & ~((c["first"] == c["root"]) & (at(c["root"])["tag"] == "PRON")))
    single = F.transform(kept, lambda c: F.struct(_joined(tokens, c["first"], c["root"]).alias("phrase"), at(c["root"])["word"].alias("root"), at(c["root"])["tag"].alias("pos")))

    def of_next(c: Column, k: Column) -> Column:
        n = F.get(chunks, k + 1)
        of, free = at(c["root"] + 1)["word"] == "of", F.coalesce(at(F.when(c["first"] > 0, c["first"] - 1))["tag"] != "ADP", F.lit(True))
        fine = lambda i: (at(i)["tag"] == "NOUN") & ~F.array_contains(excluded, F.lower(at(i)["word"]))
        yes = of & free & (n["first"] == c["root"] + 2) & fine(c["root"]) & fine(n["root"])
        return F.when(F.coalesce(yes, F.lit(False)), F.struct(_joined(tokens, c["root"], n["root"]).alias("phrase"), at(c["root"])["word"].alias("root"), F.lit("COMPOUND").alias("pos")))

    return F.concat(single, F.array_compact(F.transform(chunks, of_next)))


def _nouns(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["tag"].isin(NOUN))


def is_noun_phrase(tokens: Column) -> Column:
    """The phrase has a last word, and that is a noun."""
    return F.coalesce(F.try_element_at(tokens, F.lit(-1))["tag"].isin(NOUN), F.lit(False))


def object_name(phrase: Column, tokens: Column) -> Column:
    """The last noun in lower case; phrases of a container stay whole; without a noun the phrase."""
    low, found = F.lower(phrase), _nouns(tokens)
    container = low.rlike("^(" + "|".join(lex.CONTAINERS) + ")") & low.rlike(r"\w+\s+of\s+\w+") & phrase.contains(" of ")
    return F.when(F.size(found) == 0, low).when(container, low).otherwise(F.lower(F.try_element_at(found, F.lit(-1))["word"]))


def core_noun(label: Column, tokens: Column) -> Column:
    """The last noun's lemma; without a noun the label in lower case without spaces."""
    return F.coalesce(F.try_element_at(_nouns(tokens), F.lit(-1))["lemma"], F.replace(F.lower(label), F.lit(" "), F.lit("")))


def standard_label(label: Column, tokens: Column) -> Column:
    """The core noun, with both words for the toy made one; without a noun, spaces become underscores."""
    last = F.try_element_at(_nouns(tokens), F.lit(-1))["lemma"]
    return F.when(last.isin("teddy", "bear"), "bear").otherwise(F.coalesce(last, F.replace(F.lower(label), F.lit(" "), F.lit("_"))))


def longest_by_lemma(rows: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Of each lemma of a last word the longest phrase, the first of equals, and where the lemma first stands. Phrases without words go."""
    own = rows.withColumn("root", F.lower(F.try_element_at(F.col(tokens), F.lit(-1))["lemma"])).filter(F.col("root").isNotNull())
    pick = F.max_by("phrase", F.struct(F.length("phrase"), (-F.col("pos")).alias("p")))
    return own.groupBy(key, "root").agg(pick.alias("phrase"), F.min("pos").alias("first_pos"))
