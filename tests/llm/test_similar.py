"""Line dedup, near dedup, top-k, embeddings and language ID against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from vagari.llm import embedding_dedup as ed
from vagari.llm import langid, topk
from vagari.llm.graph import components
from vagari.llm.line_dedup import LineParams, dedup_lines, line_report
from vagari.llm.minhash_dedup import MinHashParams, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def varied(seed, n, size, vocabulary, edits):
    """Texts of which many are edits of a few."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(size)] for _ in range(3)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(vocabulary)}"
        out.append(" ".join(t))
    return out


def removed_by_hand(rows, num=4, den=5):
    sets, out = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out[k] = []
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            s = set(words(line))
            if s:
                if any(den * len(s & o) >= num * len(s | o) for o in sets):
                    out[k].append(i)
                sets.append(s)
    return out


LINES = varied(1, 60, 14, 60, 6)
CORPUS = [
    [(1, "a b c\nA b C\n\n \nx"), (2, "c b a a"), (3, None), (4, ""), (5, "x\n" * 3), (None, "x y\na b c"), (9, "é ü\né ü"), (10, "p q r s"), (11, "p q r s t")],
    [(i, "\n".join(LINES[i * 3 : i * 3 + 3])) for i in range(20)],
    [(i, "the of and to in\n" + " ".join(f"q{j}" for j in range(400)) + (f" v{i}" if i % 2 else "")) for i in range(12)],
]


@pytest.mark.parametrize("rows", CORPUS)
@pytest.mark.parametrize("p", [LineParams(), LineParams(frequent=2, nearest=2), LineParams(frequent=3, window=1), LineParams(flush_bytes=100, block_bytes=300)])
def test_line_dedup(spark, rows, p):
    df = spark.createDataFrame([(k, t, "own", 3) for k, t in rows], "doc_id long, text string, removed string, row int").repartition(3)
    want = removed_by_hand(rows)
    assert {r.doc_id: r.removed for r in line_report(df, p).collect()} == want
    clean = {r.doc_id: (r.text, r.row) for r in dedup_lines(df, p).collect()}
    assert clean == {k: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[k]) if t is not None else None, 3) for k, t in rows}


def test_line_dedup_of_nothing_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert line_report(spark.createDataFrame([], kind)).count() == 0
    got = line_report(spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (2, "c")], kind)).collect()
    assert sorted((r.doc_id, r.n_lines, r.removed) for r in got) == [(1, 2, []), (1, 2, []), (2, 1, [0])]


def test_line_dedup_of_many_random_lines(spark):
    rng = random.Random(17)
    lines = varied(21, 260, 9, 40, 5) + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(140)]
    rng.shuffle(lines)
    rows = [(i * 7 % 101, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = removed_by_hand(rows)
    for p in (LineParams(), LineParams(num=3, den=5, frequent=4), LineParams(frequent=5, flush_bytes=200, block_bytes=1000, window=2)):
        assert {r.doc_id: r.removed for r in line_report(df, p).collect()} == (want if p.num == 4 else removed_by_hand(rows, 3, 5))


def test_line_dedup_whatever_the_number_of_partitions(spark):
    from vagari.llm import line_dedup
    from vagari.llm.common import settings as session

    rng = random.Random(3)
    lines = varied(5, 150, 10, 40, 4) + [f"same first {rng.choice('abcdefgh')} {rng.randrange(30)}" for _ in range(150)]
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(60)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), removed_by_hand(rows)
    for n in ("2", "200"):
        with session(spark, spark_sql_shuffle_partitions=n):
            got = {r.doc_id: r.removed for r in line_report(df, LineParams(frequent=10**6, flush_bytes=2000, block_bytes=3000)).collect()}
        assert got == want
    sets = lambda n: spark.range(n).selectExpr("cast(10 as int) AS words")
    assert [line_dedup._bucket_count(sets(n), LineParams(block_bytes=520)) for n in (1, 1000, 4000)] == [16, 4 * 139, 4 * 554]


def test_own_columns_stay(spark):
    names = ["_removed", "_doc", "_row", "_key", "_hash", "_count", "times", "sid"]
    df = spark.createDataFrame([(1, "a b\nc", *"stuvwxyz"), (2, "c\nd", *"stuvwxyz")], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "removed", "n_left"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b\nc", *"stuvwxyz", 2, None, None), (2, "d", *"stuvwxyz", 2, [0], 1)]
    assert sorted(map(tuple, line_report(df).collect())) == [(1, 2, []), (2, 2, [0])]


def mirrored(n):
    """Two different words of 2^n letters whose polynomials modulo 2^64 agree for any base and letters."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 11, 12])
def test_mirrored_words_differ(spark, n):
    a, b = mirrored(n)
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_report(df).collect()} == {1: [], 2: [], 3: [0]}
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_hashes_of_spans_are_those_of_their_bytes():
    from vagari.llm import kernels

    rng = random.Random(11)
    own = [bytes(rng.choice(b"ab\x00") for _ in range(n)) for n in [*range(1, 60), 200, 5000] for _ in range(20)]
    for order in (own, own[::-1]):
        buf = np.frombuffer(b"".join(order), np.uint8)
        ends = np.cumsum([len(w) for w in order])
        h = kernels.span_hashes(buf, ends - [len(w) for w in order], ends).tolist()
        table = dict(zip(order, h, strict=True))
        assert len(set(table.values())) == len(table) and [table[w] for w in order] == h


def groups_by_hand(rows, num, den, size=5):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


NEAR = [(i, t) for i, t in enumerate(varied(2, 40, 120, 5000, 12))] + [(100 + i, t) for i, t in enumerate(varied(3, 30, 900, 90000, 60))]
NEAR += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "a b c d"), (206, "a b c d e"), (207, "x " * 50), (208, "X " * 70), (209, "word " * 20000)]


@pytest.mark.parametrize("num", [85, 60])
def test_near_duplicates(spark, num):
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in NEAR], "doc_id long, text string, rep int, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, MinHashParams(num=num)).collect()}
    assert got == groups_by_hand(NEAR, num, 100)


def test_near_duplicates_corners(spark):
    kind = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "A B C D E F"), (None, "a b c d e f"), (3, None)]
    got = near_duplicates(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 2, None, True), (3, 0, 3, True)], key=str)


def template(seed, many, size, own):
    """Documents that share a text but for words of their own in fixed places."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(size)]
    return [(i, " ".join(f"d{i}x{j}" if j % own == own - 1 else w for j, w in enumerate(base))) for i in range(many)] + [(many, " ".join(base))]


def test_documents_of_one_template_give_no_pairs(spark, monkeypatch):
    from vagari.llm import minhash_dedup as m

    counted = m.Scratch.store
    sizes = {}

    def store(self, df, name, keep=counted):
        out = keep(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(m.Scratch, "store", store)
    # 25 of 396 shingles are a document's own: 0.88 to each other, below 0.9, though all share the rest.
    df = spark.createDataFrame(template(1, 1500, 400, 80), "doc_id long, text string")
    rows = near_duplicates(df, MinHashParams(num=90, den=100)).collect()
    assert all(r.kept for r in rows) and sizes["near-lists"] > 1500 and sizes["near-rest"] == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, score int"


def best_by_hand(rows, k=10, every=100):
    good = [(i, v, np.floor(1024 * np.array(e, np.float64)).astype(int)) for i, (v, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, v, e in good:
        if v is not None and v % every == 0:
            s = sorted(((-int(e @ f), w is None, w or 0, w) for j, w, f in good if j != i and len(f) == len(e)))[:k]
            out += [(v, r + 1, x[3], -x[0]) for r, x in enumerate(s)]
    return sorted(out, key=str)


def unit(rng, n, d=8):
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = unit(rng, 260)
    x[50:80] = x[0]  # ties
    rows = [(i, [float(a) for a in e]) for i, e in enumerate(x)]
    rows += [(300, None), (400, []), (500, [0.1] * 7 + [float("nan")]), (600, [0.1] * 7 + [float("inf")]), (700, [None] + [0.1] * 7), (None, rows[0][1]), (100, rows[5][1]), (800, [0.0] * 8), (900, [1.0, 2.0]), (901, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    p = topk.TopKParams(block_rows=64, query_rows=2)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.repartition(3), p).collect()]
    assert sorted(got, key=str) == best_by_hand(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(100, [0.5], 1)], VECTORS)).count() == 0


def test_top_k_of_any_finite_number(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4)) * 10.0 ** rng.integers(-3, 30, (60, 4))
    x[7], x[9] = [1e300, -1e300, 1e308, 3.0], [16384.0, -20000.0, 0.5, 2.0**40]
    rows = [(i * 50, [float(a) for a in e]) for i, e in enumerate(x)]
    whole = lambda v: int(v) * 1024 if abs(v) >= 2**53 else int(np.floor(v * 1024))
    ints = {k: [whole(v) for v in e] for k, e in rows}
    want = []
    for k in (k for k in ints if k % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[k], ints[o], strict=True)), o) for o in ints if o != k)[:10]
        want += [(k, r + 1, o, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, o) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, topk.TopKParams(block_rows=16, query_rows=4)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    numbers = [0, 1, -1, 255, 256, -255, -256, -257, 1 << 70, -(1 << 70), (1 << 63) - 1, -(1 << 63)]
    assert sorted(numbers, key=topk._order) == sorted(numbers)


def test_slices_add_up():
    rng = np.random.default_rng(2)
    x = rng.integers(-1500, 1500, (200, 5))
    block = topk._block(0, list(range(1, 201)), x / 1024, topk.TopKParams())
    slices, low = np.frombuffer(block["slices"], np.uint64).reshape(5, block["width"], -1), topk._number(block["low"])
    for query in ([0] * 5, [1, -1, 7, -1024, 1023], rng.integers(-2000, 2000, 5).tolist()):
        sums, offset = topk.score_slices(slices, query, low)
        got = np.full(256, offset, np.int64)
        for b, s in enumerate(sums):
            if s is not None:
                got += np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << b
        assert (got[:200] == x @ np.array(query)).all()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    x = unit(rng, 150, 16)
    x[40:70] = x[:30] + rng.normal(scale=0.07, size=(30, 16)).astype(np.float32)
    x[70:90] = x[3]
    x[90:100] = 5 * x[4]
    rows = [(i, [float(a) for a in e]) for i, e in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 0.0]), (905, [1.0, 0.0]), (None, [float(a) for a in x[3]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df.repartition(3), ed.EmbeddingParams(tile_rows=40, block_rows=16, pairs=50)).collect()}
    vs = {v: np.array(e, np.float64) for v, e in rows if v is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    links = {v: [w for w in vs if w != v and len(vs[w]) == len(vs[v]) and vs[v] @ vs[w] / (np.linalg.norm(vs[v]) * np.linalg.norm(vs[w])) >= 0.95] for v in vs}
    root = {v: v for v, _ in rows if v is not None}
    for _ in range(40):
        for v in links:
            for w in links[v]:
                root[v] = root[w] = min(root[v], root[w])
    want = {v: (len(links.get(v, [])), root[v], root[v] == v) for v in root} | {None: (0, None, True)}
    assert got == want
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_corners(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs, langid.LangParams())
    rows = [(1, None, 5), (2, "", 5), (3, "123 !? \n", 5), (4, "the and of " * 30000, 5), (5, "\u65e5\u672c\u8a9e" * 900, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model, langid.LangParams()).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "en" and got[5][1] < 0.3
    assert {r.lang_pred for r in langid.identify(df, {}, langid.LangParams()).collect()} == {"und"}
    assert langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"), langid.LangParams()) == {}


def test_profiles_are_bound_trigrams():
    p = langid.LangParams(dims=64)
    l = lambda c: langid.letter_vector(ord(c) if c else 0, 64, p.seed).astype(int)  # noqa: E731, E741
    want = sum(np.roll(l(a), 2) * np.roll(l(b), 1) * l(c) for a, b, c in [("", "a", "b"), ("a", "b", ""), ("", "c", "")])
    got = langid.profiles(["Ab, 1 c"], p)[0]
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)


def plain_profiles(texts, p):
    """Profiles letter by letter."""
    out = []
    for t in texts:
        sum_, low = np.zeros(p.dims), [c if c.isalpha() else "" for c in (t or "").lower()]
        vector = lambda c: langid.letter_vector(ord(c) if c else 0, p.dims, p.seed).astype(int)
        for i, c in enumerate(low):
            if c:
                sum_ += np.roll(vector(low[i - 1] if i else ""), 2) * np.roll(vector(c), 1) * vector(low[i + 1] if i + 1 < len(low) else "")
        out.append(sum_ / (np.linalg.norm(sum_) or 1))
    return out


def fold(key):
    return zlib.crc32(str(key).encode()) % 5


def plain_predictions(rows, p):
    """(key, text, lang) rows; all labelled ones outside fold 0 are learned from."""
    own, sums = plain_profiles([t for _, t, _ in rows], p), {}
    for (k, t, lang), v in zip(rows, own, strict=True):
        if k is not None and t is not None and lang is not None and fold(k):
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(n for n in sums if np.linalg.norm(sums[n]))
    out = []
    for (k, _, _), v in zip(rows, own, strict=True):
        cos = [v @ sums[n] / np.linalg.norm(sums[n]) for n in names]
        best = int(np.argmax(cos)) if cos and v.any() else None
        out.append((k, k is not None and fold(k) == 0, "und" if best is None else names[best], 0.0 if best is None else max(0.0, cos[best])))
    return out


def test_language_id_equals_plain_version(spark):
    p = langid.LangParams(dims=256)
    docs = [(r.doc_id, r.text[:400], r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [*docs, (900, None, "en"), (901, "", "fr"), (902, "1 2 3", "xx"), (903, "\u65e5\u672c\u8a9e", "ja"), (904, "\u65e5\u672c", None), (None, "the of and", "en"), docs[0]]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, score string")
    got = sorted(langid.predict(df.repartition(3), p).collect(), key=str)
    want = sorted(plain_predictions(rows, p), key=str)
    assert [(r.doc_id, r.held_out, r.lang_pred) for r in got] == [w[:3] for w in want]
    assert np.allclose([r.score for r in got], [w[3] for w in want], atol=1e-4)
    assert langid.predict(df.limit(0), p).count() == 0


def test_profiles_of_many_scripts_take_little_memory():
    import tracemalloc

    rng, p = random.Random(3), langid.LangParams()
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(85)) for _ in range(2000)]
    langid.letters()
    tracemalloc.start()
    got = langid.profiles(texts, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert np.allclose(got[:3], plain_profiles(texts[:3], p), atol=1e-5)


def test_every_language_is_learned(spark):
    rows = [(i, "some text", f"l{i % 3}") for i in range(30)] + [(100, "other text", "rare")] + [(200 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} words", f"m{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(df, langid.LangParams())
    want = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert set(learned) == want and len(want) > 40
    one, two = ([tuple(r) for r in langid.predict(df, langid.LangParams(at_once=n)).orderBy("doc_id").collect()] for n in (1000, 7))
    assert [r[:3] for r in one] == [r[:3] for r in two] and np.allclose([r[3] for r in one], [r[3] for r in two], atol=1e-6)


def test_wide_and_extreme_vectors(spark):
    rng = np.random.default_rng(5)
    wide = rng.standard_normal((60, 2500))
    wide[1::3] = wide[::3] + rng.standard_normal((20, 2500)) * 0.3  # cosines near the threshold
    rows = [(i, v.tolist()) for i, v in enumerate(wide)]
    rows += [(100 + i, [s, 2 * s, -s]) for i, s in enumerate([1e200, 1e-200, 1.0, 5e-324 * 8, 1e308 / 4])] + [(200, [1e200, -1e200, 1e200]), (201, [1e-300, 0.0, 0.0])]
    got = {r.vec_id: r for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ed.EmbeddingParams(block_rows=16)).collect()}
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert [got[i].n_links for i in range(60)] == links.tolist() and links.sum() > 10
    assert all(got[100 + i].n_links == 4 and got[100 + i].component_id == 100 for i in range(5))
    assert got[200].n_links == got[201].n_links == 0


def reflowed(t):
    """The same words on other lines."""
    w = t.split()
    return "\n".join(" ".join(w[i : i + 23]) for i in range(0, len(w), 23))


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    copies = [(10_000 + r.doc_id, reflowed(r.text), r.lang, r.source, len(r.text)) for r in rows if 150 < len(r.text.split()) < 400][:20]
    docs = docs.unionByName(spark.createDataFrame(copies, docs.schema))
    counts, seen = [], set()
    for name, stage in c.STAGES:
        docs = c.stored(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == c.COLUMNS
        if name == "near_dedup":
            seen = {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(counts) and counts[2] < counts[1] < counts[0] < len(rows) + len(copies)
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= seen
    assert c.run(spark, SF).count() > 0
