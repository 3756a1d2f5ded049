"""Stages of the pipeline against brute force on small tables."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF
from test_native import taken
from test_similar import NEAR, groups_by_hand, plain_predictions, removed_by_hand, words

import corpus_pipeline as c
from vagari.llm.langid import LangParams
from vagari.llm.line_dedup import LineParams, line_report
from vagari.llm.queries import tokenizer_file

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "own", None if t is None else len(t)) for k, t in rows], KIND)


def kept_by_hand(rows, num):
    return sorted(k for k, (_, _, kept) in groups_by_hand(rows, num, 100).items() if kept)


def test_near_dedup_from_four_fifths_on(spark):
    base = [f"p{i}" for i in range(120)]
    twice = [f"edit{i}" if i in (30, 80) else w for i, w in enumerate(base)]  # 106 of 126 shingles in common: 0.841
    thrice = [f"other{i}" if i in (20, 50, 90) else w for i, w in enumerate(base)]  # 101 of 131: 0.771
    rows = [*NEAR, (300, " ".join(base)), (301, " ".join(twice)), (302, " ".join(thrice))]
    want = kept_by_hand(rows, 80)
    assert 301 not in want and 302 in want and 301 in kept_by_hand(rows, 85)
    got = c.near_dedup(spark, documents(spark, rows).repartition(4), "")
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("p", [LineParams(), LineParams(frequent=2, nearest=1)])
def test_the_earliest_line_stays_whatever_the_order_of_rows(spark, p):
    a, b = "a b c d e f g h i", "a b c d e f g h i j"
    rows = [(50, a), (20, b), (3, a), (None, a)]
    df = documents(spark, rows).coalesce(1)
    assert [r.doc_id for r in df.collect()] == [50, 20, 3, None]
    assert {r.doc_id: r.removed for r in line_report(df, p).collect()} == {50: [0], 20: [0], 3: [], None: [0]} == removed_by_hand(rows)


ODD = [(None, "no key, but a text"), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (904, "one"), (905, "long " * 9000), (906, "1 2\n3")]


@pytest.mark.parametrize("name, stage", c.STAGES)
def test_stages_of_nothing_and_odd_rows(spark, name, stage):
    assert stage(spark, documents(spark, []), "").count() == 0
    out = stage(spark, documents(spark, ODD).withColumn("removed", c.F.lit(1)), "")
    assert out.count() and (name == "packing" or out.columns == c.COLUMNS)


def test_language_stage_keeps_texts_of_a_language(spark):
    docs = [(r.doc_id, r.text[:300], r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    dressed = [(1000 + i, " ".join(w + "$$$" for w in words(t)), lang) for i, (_, t, lang) in enumerate(docs[:5])]
    rows = [*docs, *dressed, (2000, None, "en"), (2001, "12 $ 3", "en"), (2002, "ok", "en"), (2003, "ok $$$$$$$$", "en")]
    guess = {k: (lang, score) for k, _, lang, score in plain_predictions(rows, LangParams())}
    want = []
    for k, t, _ in rows:
        n, signs = sum(x.isalpha() for x in t or ""), sum(__import__("unicodedata").category(x)[0] in "PS" for x in t or "")
        if guess[k][0] != "und" and (n < 40 or (guess[k][1] >= 0.12 and n >= 0.8 * (n + signs))):
            want.append(k)
    df = spark.createDataFrame([(k, t, lang, "own", 1) for k, t, lang in rows], KIND)
    got = sorted(r.doc_id for r in c.language_id(spark, df, "").collect())
    assert got == sorted(want) and not {r[0] for r in dressed} & set(got) and {2002, 2003} <= set(got)


def test_line_stage(spark):
    rows = [(1, "a b c\nd e"), (2, "A b c\nf g"), (3, "d e\na b c"), (4, "\na b c\n \n"), (5, None), (6, " "), (7, "h i\nh i"), (7, "h i\nh i"), (None, "f g\nz")]
    gone = removed_by_hand(list(dict(rows).items()))
    want = []
    for k, t in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])
        if not gone[k] or words(left):
            want.append((k, left, None if left is None else len(left)))
    got = [(r.doc_id, r.text, r.n_chars) for r in c.line_dedup(spark, documents(spark, rows).repartition(3), "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {3, 4}.isdisjoint(k for k, *_ in got)


def test_near_stage_keeps_one_row_of_a_document(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(5, t), (5, t), (5, t + " x"), (6, t), (7, "other"), (7, "other"), (None, t), (None, t)]
    got = c.near_dedup(spark, documents(spark, rows), "").collect()
    assert Counter(r.doc_id for r in got) == {5: 1, 7: 1, None: 2}
    assert {r.text for r in got if r.doc_id == 5} == {t}


def test_mixing_stage(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}") for i in range(100)] + [(200, None, "s0"), (201, "", None)]
    df = spark.createDataFrame([(k, t, "en", s, 1) for k, t, s in rows], KIND)
    want = {k: int(n / z + 0.5) for k, z, _, _, n in taken(rows) if z and int(n / z + 0.5)}
    assert Counter(r.doc_id for r in c.mixing(spark, df, "").collect()) == want


def test_packing_stage(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    rows = [(i, "some words " * (i * 13 % 700)) for i in range(40)] + [(100, None)]
    ids = {}
    for r in c.packing(spark, documents(spark, rows), "").collect():
        ids.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert {k: [x for s in sorted(p) for x in p[s]] for k, p in ids.items()} == {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
