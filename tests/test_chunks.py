"""Noun chunks, compounds, lemmas and names on fixtures of phrases."""

import random

import pytest
from pyspark.sql import functions as F

from vagari.operators import chunks as c

WORDS = [("red", "ADJ", "red"), ("small", "ADJ", "small"), ("mice", "NOUN", "mouse"), ("rex", "PROPN", "rex"), ("view", "NOUN", "view"), ("stands", "VERB", "stand"), ("runs", "VERB", "run")]


@pytest.fixture(scope="module")
def table(spark):
    return c.closed_words(spark).unionByName(spark.createDataFrame(WORDS, "word string, tag string, lemma string"))


def found(spark, table, texts):
    rows = c.tagged(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], "t", table).withColumn("ch", c.noun_chunks(F.col("tokens")))
    got = rows.withColumn("got", c.candidates(F.col("tokens"), F.col("ch"))).collect()
    return {r.k: [tuple(x) for x in r.got] for r in got}


CASES = [
    ("The red cup stands near two mice.", [("The red cup", "cup", "NOUN"), ("two mice", "mice", "NOUN")]),
    ("a stack of books on it", [("a stack", "stack", "NOUN"), ("books", "books", "NOUN"), ("stack of books", "stack", "COMPOUND")]),
    ("near a stack of books", [("a stack", "stack", "NOUN"), ("books", "books", "NOUN")]),  # the head is itself the object of a preposition
    ("the view of a lamp", [("a lamp", "lamp", "NOUN")]),  # an excluded root, also of a compound
    ("they hold the dog's small bowl", [("hold", "hold", "NOUN"), ("the dog 's small bowl", "bowl", "NOUN")]),
    ("the the red", []), ("", []), (None, []), ("Rex runs", [("Rex", "Rex", "PROPN")]), ("left hand", []), ("dog's the cat", [("dog", "dog", "NOUN"), ("the cat", "cat", "NOUN")]),
    ("cup of Rex", [("cup", "cup", "NOUN"), ("Rex", "Rex", "PROPN")]), ("cup Of tea", [("cup", "cup", "NOUN"), ("tea", "tea", "NOUN")]),
]


def test_candidates(spark, table):
    got = found(spark, table, [t for t, _ in CASES])
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def by_hand(letters):
    """Chunks of a string of tags, token by token with a list."""
    out, i = [], 0
    while i < len(letters):
        j = i
        if letters[j] == "P":
            out.append((i, i))
            i += 1
            continue
        if letters[j] == "D":
            j += 1
        root = -1
        while True:
            while j < len(letters) and letters[j] == "A":
                j += 1
            n = j
            while n < len(letters) and letters[n] == "N":
                n += 1
            if n == j:
                break
            root = n - 1
            if n < len(letters) and letters[n] == "S":
                j = n + 1
                continue
            break
        if root >= 0:
            out.append((i, root))
            i = root + 1
        else:
            i += 1
    return out


def test_grammar_equals_a_scan(spark):
    rng = random.Random(3)
    names = {"D": "DET", "A": "ADJ", "N": "NOUN", "S": "PART", "P": "PRON", "O": "VERB"}
    rows = ["".join(rng.choice("DANNSPO") for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(r, [(i, r[i], names[r[i]], "x") for i in range(len(r))]) for r in rows], f"r string, tokens {c.TOKENS}")
    for r in df.select("r", c.noun_chunks(F.col("tokens")).alias("ch")).collect():
        assert [(x.first, x.root) for x in r.ch] == by_hand(r.r), r.r


def test_names_and_lemmas(spark, table):
    texts = ["red boxes", "Bowl of small berries", "teddy", "small", "two mice", "churches", "glass", None, "grey bus"]
    rows = c.tagged(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], "t", table)
    got = {r.k: tuple(r)[1:] for r in rows.select("k", c.object_name(F.col("t"), F.col("tokens")), c.core_noun(F.col("t"), F.col("tokens")), c.standard_label(F.col("t"), F.col("tokens")), c.is_noun_phrase(F.col("tokens"))).collect()}
    assert got[0] == ("boxes", "box", "box", True) and got[1] == ("bowl of small berries", "berry", "berry", True) and got[2] == ("teddy", "teddy", "bear", True)
    assert got[3] == ("small", "small", "small", False) and got[4] == ("mice", "mouse", "mouse", True) and got[5][1] == "church" and got[6][1] == "glass" and got[7] == (None, None, None, False) and got[8][1] == "bus"


def test_longest_by_lemma(spark, table):
    rows = spark.createDataFrame([(1, 0, "box"), (1, 1, "red boxes"), (1, 2, "two boxes"), (1, 3, "mice"), (1, 4, ""), (2, 0, "mouse")], "k int, pos int, phrase string")
    got = c.longest_by_lemma(c.tagged(rows, ["k", "pos"], "phrase", table), "k").orderBy("k", "first_pos").collect()
    assert [tuple(r) for r in got] == [(1, "box", "red boxes", 0), (1, "mouse", "mice", 3), (2, "mouse", "mouse", 0)]


def test_tokens_are_not_broadcast(spark):
    """A small file can hold many tokens: 1,200,000 parts in 5 MB took all the driver's memory when their tokens were broadcast."""
    from conftest import SF

    from vagari.plans import registry

    registry.load()
    for key in ("T02", "T06", "A17"):
        plan = registry.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan, key
