"""Text and JSON functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..params import PromptParams
from . import lexicons as lex


def words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def exclusion_lexicon() -> Column:
    """The union of the five word lists."""
    out = words(lex.POSITION_WORDS)
    for more in (lex.ABSTRACT_WORDS, lex.BODY_PARTS, lex.PREPOSITIONS, lex.DESCRIPTORS):
        out = F.array_union(out, words(more))
    return out


def preprocess(text: Column) -> Column:
    """White space collapsed and trimmed, then 's, 're and 'm written out, in this order."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    for short, full in lex.SHORT_FORMS:
        out = F.replace(out, F.lit(short), F.lit(full))
    return out


def is_object_phrase(phrase: Column) -> Column:
    """The rules that keep a candidate phrase."""
    low = F.lower(phrase)
    parts = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    excluded = exclusion_lexicon()
    all_excluded = F.forall(parts, lambda w: F.array_contains(excluded, w))
    place = low.isin(lex.PLACE_PHRASES)
    starts = F.coalesce(F.get(parts, F.lit(0)).isin(lex.PLACE_STARTS), F.lit(False)) & (F.size(parts) <= 2)
    being = (F.size(parts) <= 3) & F.array_contains(parts, "being") & F.arrays_overlap(parts, words(lex.PLACE_INNER))
    return ~(all_excluded | place | starts | being)


def nouns(phrase: Column) -> Column:
    """Stand-in for a tagger: each word of the phrase is a noun."""
    return F.filter(F.split(phrase, r"\s+"), lambda w: w != "")


def object_name(phrase: Column) -> Column:
    """The last noun in lower case; phrases of a container stay whole; without a noun the phrase."""
    low = F.lower(phrase)
    container = low.rlike("^(" + "|".join(lex.CONTAINERS) + ")") & low.rlike(r"\w+\s+of\s+\w+") & phrase.contains(" of ")
    return F.when(F.size(nouns(phrase)) == 0, low).when(container, low).otherwise(F.lower(F.try_element_at(nouns(phrase), F.lit(-1))))


def core_noun(label: Column) -> Column:
    """The last noun's lemma (here: its lower case); without a noun the label without spaces."""
    return F.when(F.size(nouns(label)) == 0, F.replace(F.lower(label), F.lit(" "), F.lit(""))).otherwise(F.lower(F.try_element_at(nouns(label), F.lit(-1))))


def standard_label(label: Column) -> Column:
    """The core noun, with both words for the toy made one; without a noun, spaces become underscores."""
    last = F.lower(F.try_element_at(nouns(label), F.lit(-1)))
    return F.when(F.size(nouns(label)) == 0, F.replace(F.lower(label), F.lit(" "), F.lit("_"))).when(last.isin("teddy", "bear"), "bear").otherwise(last)


def detector_prompt(phrases: Column) -> Column:
    """T10"""
    return F.array_join(phrases, " . ")


def numbered(phrases: Column) -> Column:
    """1-based numbers before each phrase, one a line."""
    return F.array_join(F.transform(phrases, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def yes_no_prompt(phrases: Column, p: PromptParams = PromptParams()) -> Column:
    """Asks about each numbered phrase; no phrases, no prompt."""
    return F.when(F.size(phrases) == 0, "").otherwise(F.format_string(p.yes_no, numbered(phrases)))


def answer_part(response: Column, prompt: Column) -> Column:
    """The segment after the first [/INST]; else what follows the prompt; else the last 500 characters."""
    marked = F.instr(response, "[/INST]") > 0
    at = F.call_function("instr", response, prompt)
    after = F.substring_index(response, prompt, -1) if isinstance(prompt, str) else F.element_at(F.split(response, F.concat(F.lit(r"\Q"), prompt, F.lit(r"\E"))), -1)
    return F.trim(F.when(marked, F.get(F.split(response, r"\[/INST\]"), F.lit(1))).when(at > 0, after).otherwise(F.right(response, F.lit(500))))


def yes_indices(response: Column, n: Column | int) -> Column:
    """0-based numbers marked yes; if there are none, the numbers of lines with 'yes'. Repeats stay."""
    n = F.lit(n) if isinstance(n, int) else n
    found = F.regexp_extract_all(response, F.lit(r"(\d+)[.:)]?\s*(?:yes|Yes|YES)"), F.lit(1))
    marked = F.filter(F.transform(found, lambda x: x.try_cast("int") - 1), lambda i: (i >= 0) & (i < n))
    lines = F.split(response, "\n")
    spoken = F.filter(F.transform(lines, lambda l, i: F.when((i < n) & F.lower(l).contains("yes"), i)), lambda i: i.isNotNull())
    return F.when(F.size(marked) > 0, marked).otherwise(spoken)


def simplify_prompt(caption: Column, p: PromptParams = PromptParams()) -> Column:
    """T14; no caption, no prompt."""
    return F.when(caption.isNotNull(), F.format_string(p.simplify, F.trim(caption.cast("string"))))


def clean_answer(text: Column) -> Column:
    """Cut at 'Note:' and at a code fence, first line that isn't blank, then each known opening once, in order."""
    out = F.trim(F.substring_index(F.trim(text), "Note:", 1))
    out = F.trim(F.substring_index(out, "```", 1))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    out = F.coalesce(F.get(lines, F.lit(0)), out)
    for opening in lex.ANSWER_OPENINGS:
        out = F.when(out.startswith(opening), F.trim(F.substring(out, len(opening) + 1, 1 << 30))).otherwise(out)
    return out


def index_of_file(name: Column) -> Column:
    """The number that a file name begins with, or null."""
    return F.regexp_extract(name, r"^(\d+)", 1).try_cast("int")


def object_lines(dets: Column, scores: bool) -> Column:
    """A numbered line for each detection with its box and, on request, its score."""
    place = lambda d: F.array_join(F.transform(d["location"], lambda v: F.format_string("%.1f", v)), ", ")
    conf = lambda d: F.format_string(" (confidence: %.2f)", d["score"]) if scores else F.lit("")
    return F.array_join(F.transform(dets, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d["category"], conf(d), F.lit(": location ["), place(d), F.lit("]"))), "\n")


def assistant_answer(text: Column, prompt: Column) -> Column:
    """After the last ASSISTANT:, else after the last 'assistant' (the whole text if it has the word in capitals only), else without the prompt's length."""
    rest = F.substr(text, F.length(prompt) + 1)
    answer = F.when(F.instr(text, "ASSISTANT:") > 0, F.substring_index(text, "ASSISTANT:", -1)).when(F.instr(F.lower(text), "assistant") > 0, F.substring_index(text, "assistant", -1)).otherwise(rest)
    return F.regexp_replace(answer, r"^\s+|\s+\z", "")


def relation_prompt(kind: str, objects: Column, p: PromptParams = PromptParams()) -> Column:
    """Kind: direction, distance, contact or confidence."""
    return F.format_string(getattr(p, kind), objects)


def synthesis_prompt(direction: Column, distance: Column, contact: Column, confidence: Column, p: PromptParams = PromptParams()) -> Column:
    """T19"""
    return F.format_string(p.synthesis, direction, distance, contact, confidence)


def json_list(text: Column, item: str = schemas.SENTENCE) -> Column:
    """The list from the first [ to the last ]; anything that doesn't parse gives an empty list."""
    kind = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in item.split(', '))}>>"
    body = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.when(body != "", body), kind), F.array().cast(kind))


def evaluation_prompts(sentence: Column, scene: Column, objects: Column, term: Column) -> Column:
    """Up to four prompts with type, text and weight."""
    two = F.coalesce(F.size(objects) >= 2, F.lit(False))
    a, b = F.get(objects, F.lit(0)), F.get(objects, F.lit(1))
    given = lambda c: F.coalesce(c != "", F.lit(False))
    # A missing part empties the text, so the parts are joined by concat, which is null then.
    filled = lambda template, *parts: F.concat(*(x for i, t in enumerate(template.split("%s")) for x in ([F.lit(t)] if t else []) + ([parts[i]] if i < len(parts) else [])))
    texts = {
        "full_match": sentence,
        "objects": F.when(two, filled(lex.OBJECTS_PROMPT, a, b)),
        "spatial_relation": F.when(given(term), F.when(two, F.concat_ws(" ", a, term, b)).otherwise(sentence)),
        "scene": F.when(given(scene), F.when(two, filled(lex.SCENE_OBJECTS_PROMPT, scene, a, b)).otherwise(filled(lex.SCENE_PROMPT, scene))),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("type"), t.alias("text"), F.lit(lex.PROMPT_WEIGHTS[k]).alias("weight")) for k, t in texts.items()))
    return F.filter(rows, lambda r: r["text"].isNotNull())


def reasoning(final: Column, dims: Column, objects: Column, term: Column, scene: Column) -> Column:
    """One sentence for the whole score and one for each dimension present."""
    full, objs, rel, scn = (F.try_element_at(dims, F.lit(k)) for k in lex.PROMPT_WEIGHTS)
    whole = F.lit(lex.WHOLE_SCORE[-1][1])
    for least, sentence in lex.WHOLE_SCORE[-2::-1]:
        whole = F.when(final >= least, sentence).otherwise(whole)

    def band(score: Column, texts: list[str], *values: Column) -> Column:
        say = [F.format_string(t, *values[: t.count("%")]) if "%" in t else F.lit(t) for t in texts]
        return F.when(score > 0.7, say[0]).when(score > 0.5, say[1]).when(score.isNotNull(), say[2])

    named = (F.get(objects, F.lit(0)), F.get(objects, F.lit(1)))
    return F.concat_ws(" ", whole, band(full, lex.FULL_MATCH, full), band(objs, lex.OBJECTS, *named), band(rel, lex.RELATION, term), band(scn, lex.SCENE, scene))


def fuzzy_key(term: Column) -> Column:
    """The key under which a term is looked up."""
    return F.trim(F.lower(term))


def fixed(x: Column, digits: int) -> Column:
    """x >= 0 with so many decimals, rounded as C and Python do: the double's exact value, ties to even. format_string rounds its shortest decimal form, ties up."""
    whole, scale = F.floor(x), 10**digits
    places = min(52, 62 - scale.bit_length())  # binary places that fit a long when multiplied with scale
    ring = 1 << places
    bits = (x - whole) * ring
    low = (bits - F.floor(bits)) * ring  # what lies below these places
    low = F.floor(low) * scale
    part = F.floor(bits) * scale + F.shiftright(low, places)
    digit, rest = F.shiftright(part, places), part.bitwiseAND(F.lit(ring - 1))
    up = (rest > ring // 2) | ((rest == ring // 2) & ((low.bitwiseAND(F.lit(ring - 1)) > 0) | (digit % 2 == 1)))
    total = whole * scale + digit + up.cast("long")
    return F.concat(((total - total % scale) / scale).cast("long").cast("string"), F.lit("."), F.lpad((total % scale).cast("string"), digits, "0"))


def duration(seconds: Column) -> Column:
    """T25"""
    said = lambda x, digits, unit: F.concat(fixed(x, digits), F.lit(unit))
    return F.when(seconds < 60, said(seconds, 1, " seconds")).when(seconds < 3600, said(seconds / 60, 1, " minutes")).otherwise(said(seconds / 3600, 2, " hours"))


def generated_name(sentence: Column, image: Column) -> Column:
    """T26"""
    return F.format_string("sentence_%03d_image_%d.png", sentence, image)


def model_type(path: Column) -> Column:
    """By the last path part in lower case. The first pattern has capitals and so never fits."""
    name = F.lower(F.substring_index(path, "/", -1))
    out = F.lit("stable_diffusion")
    for part, kind in lex.MODEL_TYPES[::-1]:
        out = F.when(name.contains(part), kind).otherwise(out)
    return out


def picked_sentence(caption: Column, draw: Column) -> Column:
    """Of the parts after the first full stop, one by 'draw' if there are two or more (the first of them if that is empty); else the first part."""
    parts = F.split(caption, r"\.")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    one = F.get(rest, (draw % F.size(rest)).cast("int"))
    return F.when(F.size(rest) > 1, F.when(one == "", F.get(rest, F.lit(0))).otherwise(one)).otherwise(F.get(parts, F.lit(0)))


def shard_pattern(stems: Column, ext: Column) -> Column:
    """{a,b,...}.ext"""
    return F.concat(F.lit("{"), F.concat_ws(",", stems), F.lit("}."), ext)


def shard_range(pattern: Column) -> Column:
    """Start and end of a..b."""
    return F.struct(F.regexp_extract(pattern, r"(\d+)\.\.(\d+)", 1).try_cast("int").alias("start"), F.regexp_extract(pattern, r"(\d+)\.\.(\d+)", 2).try_cast("int").alias("end"))


def bar(percent: Column) -> Column:
    """T30"""
    return F.repeat(F.lit("█"), F.floor(percent / 2).cast("int"))


def mutually_contained(a: Column, b: Column) -> Column:
    """T31"""
    return F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))


def chat(system: str, user: Column) -> Column:
    """T33"""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def level_phrases(a: Column, b: Column, p: PromptParams = PromptParams()) -> Column:
    """One text for each level."""
    return F.array(*(F.format_string(t, a, b) for t in p.levels))


def padded(ids: Column, length: int, pad: int) -> Column:
    """Cut or filled to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def tsv_safe(text: Column) -> Column:
    """K05"""
    return F.trim(F.translate(text, "\t\n", "  "))
