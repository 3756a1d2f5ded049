"""Url filter, mixing and sharding against plain Python and SQL."""

import hashlib
import random
import re

import pytest
from conftest import SF
from oracle import rows_of_duckdb, rows_of_spark

from vagari.llm import mixing, sharding
from vagari.llm import queries as q
from vagari.llm import url_filter
from vagari.llm.url_filter import Rule, host_rule, judge_urls, rules_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("key", ["op2_url_filter", "op3_top_k", "op7_mixing", "op8_embedding_dedup", "op10_sharding", "op11_fill_in_middle"])
def test_query_equals_sql(spark, key):
    assert rows_of_spark(q.QUERIES[key](spark, SF)) == rows_of_duckdb(q.ORACLES[key], SF)


@pytest.mark.parametrize("key", ["op2_url_filter", "op7_mixing", "op10_sharding"])
def test_native_plans_have_no_python(spark, key):
    plan = q.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapInArrow|ExternalRDD", plan)


URLS = [
    ("http://a.Example.COM/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://x.net/es/a#b", "x.net", "/es/a", "net/es/", "block"),
    ("https://x.net/esx", "x.net", "/esx", None, "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://com/", "com", "/", "com/", "allow"),
    ("http://x.org?q=/en/", "x.org", "", None, "allow"),
    ("https://spam-farm.example.org/a", "spam-farm.example.org", "/a", None, "block"),
    ("a://b://c.com/", "b:", "//c.com/", None, "allow"),
    ("no scheme.com/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


@pytest.mark.parametrize("inline", [2000, 0])
def test_urls(spark, inline):
    rows = [(i, u, "own") for i, (u, *_) in enumerate(URLS)] * 2
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "page_id long, url string, verdict string, tokens int, _best int")
    judged = judge_urls(df, q.url_rules(), inline=inline)
    assert judged.columns == ["page_id", "url", "tokens", "_best", "host", "path", "rule", "verdict"]
    assert {(r.tokens, r._best) for r in judged.collect()} == {(7, 8)}
    got = judged.select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *u[1:]) for i, u in enumerate(URLS)] * 2, key=str)
    assert judge_urls(df.limit(0), q.url_rules(), inline=inline).count() == 0


def test_rule_without_literal_and_longest(spark):
    rules = [host_rule("a.b/x/", "block"), host_rule("a.b/x/y/", "allow"), Rule("any", "(?s).*", (), "block", 1)]
    df = spark.createDataFrame([("http://a.b/x/1",), ("http://a.b/x/y/1",), ("http://é.q/",)], "url string")
    assert [r.rule for r in judge_urls(df, rules).orderBy("url").collect()] == ["a.b/x/", "a.b/x/y/", "any"]


def fits_by_hand(line, place):
    """Filter lines by backtracking over characters, without a regular expression."""
    body = line.removeprefix("@@")
    host, left = body.startswith("||"), body.startswith("|")
    body, right = body.lstrip("|"), body.endswith("|")
    body = body.rstrip("|")

    def match(i, j):
        if i == len(body):
            return j == len(place) or not right
        if body[i] == "*":
            return any(match(i + 1, k) for k in range(j, len(place) + 1))
        if body[i] == "^":
            part = lambda c: c.isascii() and c.isalnum() or c in "_.%-"
            return (j == len(place) and match(i + 1, j)) or (j < len(place) and not part(place[j]) and match(i + 1, j + 1))
        return j < len(place) and place[j] == body[i] and match(i + 1, j + 1)

    ends = place.find("/") if "/" in place else len(place)
    starts = [0, *(i + 1 for i in range(ends) if place[i] == ".")] if host else [0] if left else range(len(place) + 1)
    return any(match(0, j) for j in starts)


def test_thousands_of_filter_lines(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["ad", "ads", "track", "img", "news", "shop", "en", "x1", "pixel", "go"]) + rng.choice(["", "er", str(rng.randrange(60))])
    lines = [f"||{word()}.{word()}.{rng.choice(['com', 'net'])}^" for _ in range(1500)] + [f"/{word()}/{word()}^" for _ in range(900)] + [f"@@||{word()}.com/{word()}/" for _ in range(500)] + [f"{word()}*/{word()}" for _ in range(60)] + [f"|{word()}.com/{word()}|" for _ in range(300)]
    table = spark.createDataFrame([(x,) for x in [*lines, *lines[:5], "! comment", "", None]], "line string")
    rules = rules_of(table)
    assert sorted(r.name for r in rules) == sorted(set(lines)) and len(rules) > 2500
    urls = [f"http://{word()}.{word()}.{rng.choice(['com', 'net'])}/{word()}/{word()}/{word()}" for _ in range(250)] + [f"http://{word()}.com/{word()}" for _ in range(150)] + [None, "x"]
    got = {r.url: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    want = {}
    for u in urls:
        place = u.split("://")[1] if u and "://" in u else ""
        own = [x for x in sorted(set(lines)) if place and fits_by_hand(x, place)]
        rule = max(own, key=lambda x: (x.startswith("@@"), len(x), x), default=None)
        want[u] = (rule, "block" if rule and not rule.startswith("@@") else "allow")
    assert got == want and {v for _, v in want.values()} == {"allow", "block"}


def test_lines_without_a_literal_beside_thousands_of_others(spark):
    lines = [f"||host{i}.com^" for i in range(200)] + ["*oo*a*", "@@*x*z*", "*q*"]
    rules = [url_filter.list_rule(x) for x in lines]
    assert sum(not r.tokens for r in rules) == 3
    urls = ["http://foo.net/abc", "http://host3.com/", "http://host3.com/oo/a", "http://x.org/yz", "http://none.org/", None]
    by = [{r.url: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules, inline=n).collect()} for n in (128, 1000)]
    assert by[0] == by[1] and by[0]["http://x.org/yz"] == ("@@*x*z*", "allow") and by[0]["http://foo.net/abc"] == ("*oo*a*", "block")
    assert by[0]["http://host3.com/"] == ("||host3.com^", "block") and by[0][None] == (None, "allow")


DOCS = "doc_id long, text string, source string, size long"


def taken(docs):
    """The closed form of what the schedule takes."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {n: sum(z for z, d in zip(size, docs, strict=True) if d[2] == n) for n in names}
    targets = dict(zip(names, mixing.water_fill([total[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    md5 = lambda b: hashlib.md5(b).hexdigest()
    out = []
    for n in names:
        own = [(md5((f"{d[0]}:" if d[0] is not None else "").encode() + md5((d[1] or "").encode()).encode()), d[0], z) for d, z in zip(docs, size, strict=True) if d[2] == n]
        at, words = 0, int(targets[n])
        for _, k, z in sorted(own, key=lambda o: (o[0], o[1] if o[1] is not None else -1)):
            full, rest = divmod(words, total[n]) if total[n] else (0, 0)
            out.append((k, z, total[n], round(targets[n], 6), full * z + max(0, min(at + z, rest) - at)))
            at += z
    return sorted(out, key=str)


CASES = [
    [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}") for i in range(200)],
    [(i, "w " * (900 if i else 5000), "a" if i % 3 else None) for i in range(30)] + [(40, None, "a"), (41, " \n\t", "b"), (42, "one", "c"), (42, "one", "c"), (None, "two words", "z")],
    [(1, "only", "a")],
    [(1, None, None), (2, "", "x")],
]


@pytest.mark.parametrize("docs", CASES)
def test_mix_equals_closed_form(spark, docs):
    df = spark.createDataFrame([(k, t, s, 9) for k, t, s in docs], DOCS)
    schedule, documents = mixing.mix(df, mixing.MixParams(block_words=16, slots_chunk=64, bucket_docs=8, span_buckets=3))
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in documents.collect()), key=str)
    assert got == taken(docs)
    assert sum(r.length for r in schedule.collect()) == sum(g[-1] for g in got)
    assert all(g[-1] <= 3 * g[1] for g in got)


def test_mix_of_nothing_and_reruns(spark):
    empty = spark.createDataFrame([], DOCS)
    schedule, documents = mixing.mix(empty)
    assert schedule.count() == documents.count() == 0 and mixing.mixed_documents(empty).count() == 0
    df = spark.createDataFrame([(k, t, s, 9) for k, t, s in CASES[0]], DOCS)
    a, b = (sorted(map(tuple, mixing.mix(df.repartition(n))[1].collect())) for n in (1, 7))
    assert a == b


def test_mixed_documents_repeat_as_taken(spark):
    df = spark.createDataFrame([(k, t, s, 9) for k, t, s in CASES[0]], DOCS)
    want = {k: int(n / z + 0.5) for k, z, _, _, n in taken(CASES[0]) if int(n / z + 0.5)}
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert got == want and mixing.mixed_documents(df).columns == df.columns
    own = df.selectExpr("*", "1 AS _row", "2 AS _nth", "3 AS _times", "4 AS _copy")
    out = mixing.mixed_documents(own)
    assert out.columns == own.columns and {tuple(r)[4:] for r in out.collect()} == {(1, 2, 3, 4)}


def test_schedule_follows_weights():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    assert mixing.water_fill([10, 1000], [5, 2], 3) == [30.0, 980.0]


def test_shards_fit(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(300)] + [(7, "y" * 100)] * 50 + [(None, None)] * 20 + [(900, "z" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, depth int")
    out = sharding.shard(df, 2000, overhead=4).collect()
    assert len(out) == len(rows)
    sums = {}
    for r in out:
        n, b = sums.get(r.shard_id, (0, 0))
        sums[r.shard_id] = (n + 1, b + r.n_bytes)
        assert len(r.shard_id) == r.depth + 1
    for r in out:
        assert sums[r.shard_id] == (r.shard_rows, r.shard_bytes)
        assert r.shard_bytes <= 2000 or r.shard_rows == 1
    ids = sorted(sums)
    assert not any(b[1:].startswith(a[1:]) for a in ids for b in ids if a != b)  # no shard holds another
    assert sharding.shard(df.limit(0), 2000).count() == 0
