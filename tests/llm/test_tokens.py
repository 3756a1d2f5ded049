"""BPE, Elias-Fano, token files and packing against the library and by round trip."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vagari.llm import packing
from vagari.llm.bpe import encoder
from vagari.llm.elias_fano import EliasFano
from vagari.llm.queries import tokenizer_file
from vagari.llm.token_files import token_digest

ODD = ["", "a", "  a  b ", "a\n\n b", "  x  y", "x\u00a0 y", "z\u3000\u3000w \u00a0v", "it's we'll 'd  ", "<|endoftext|> hi", "hi <|endoftext|> there", "a<|endoftext|><|endoftext|>\u00a0 b<|endoftext|>", "x<|endoftext|", "|endoftext|>y", "<|endoftext|>", " lead", "trail ", "\t\tx\r\n y", "caf\u00e9's na\u00efve, \u00e9t\u00e9. a\u00d7b \u00f7c", "\u65e5\u672c\u8a9e \u30c6", " ", " \n ", "a" * 3000, "x.y,z don't. \u00c9!", "\U0001f600 ok", "e\u0301 a", None]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def ids_of(texts):
    out = []
    for _, ids, counts in encoder(tokenizer_file()).encode(pa.array(texts, pa.string())):
        ends = np.cumsum(counts)
        out += [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
    return out


def test_ids_equal_library(library):
    assert ids_of(ODD) == [library(t) for t in ODD]
    assert ids_of(ODD * 2) == [library(t) for t in ODD * 2]  # a second time from memory


def test_long_words_equal_library(library):
    a, b = "a", "b"
    for n in range(12):
        a, b = a + b, b + a
        if n >= 9:
            assert ids_of([a, b, a, f"{b} {a}"]) == [library(t) for t in (a, b, a, f"{b} {a}")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t'.,sSé\u00a0\u3000\u20092×ñ日"), max_size=12), max_size=4))
def test_ids_equal_library_on_any_text(library, texts):
    assert ids_of(texts) == [library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", " ", "a", "\u00a0", ",", "\n"]), max_size=8).map("".join), max_size=4))
def test_added_tokens_equal_library(library, texts):
    assert ids_of(texts) == [library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=1500))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    ef = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    n = len(values)
    for lo, hi in ((0, n), (n // 3, n // 2), (n - 1 if n else 0, n)):
        assert ef.select(lo, hi).tolist() == values[lo:hi].tolist()
    assert len(ef.lows) + len(ef.highs) <= n * (3 + np.log2(values[-1] / n + 2)) / 8 + 200 if n else True


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def docs(spark, rows):
    return spark.createDataFrame([(k, t, -1) for k, t in rows], "doc_id long, text string, start long")


def test_files_hold_all_documents(spark, library):
    rows = [(i * 3 - 5, t) for i, t in enumerate(ODD)] + [(1, "again"), (1, "again"), (None, "no key")]
    got = token_digest(docs(spark, rows).repartition(3), tokenizer_file(), end_id=0)
    want, at = [], 0
    by_key = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, t in by_key:
        ids = [*library(t), 0]
        want.append((k, len(ids), crc(ids)))
    own = got.collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in own), key=str) == sorted(want, key=str)
    for r in sorted(own, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(own, key=lambda r: r.start)] == [k for k, _ in by_key]
    assert token_digest(docs(spark, []), tokenizer_file()).count() == 0


def test_keys_of_any_size_and_repeated_keys_in_any_order(spark, library):
    rows = [(k, f"t {k}") for k in (-(1 << 63), -5, -1, 0, 7, 1 << 40, (1 << 63) - 1)] + [(7, f"text {i}") for i in range(30)] + [(None, f"null {i}") for i in range(9)] + [(3, "same")] * 40
    runs = [token_digest(docs(spark, rows[::step]).repartition(n), tokenizer_file(), end_id=0).drop("shard").collect() for step, n in ((1, 1), (-1, 5))]
    one, two = (sorted(map(tuple, r), key=str) for r in runs)
    assert one == two and len(one) == len(rows)
    assert [r.doc_id for r in sorted(runs[0], key=lambda r: r.start)] == [k for k, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 70, "some words " * (i * 13 % 90)) for i in range(200)] + [(None, None)] * 5
    p = packing.PackParams(tokenizer_file(), group_docs=40)
    one, two = (sorted(map(tuple, packing.pack(docs(spark, rows[::step]).repartition(n), p).collect()), key=str) for step, n in ((1, 1), (-1, 5)))
    assert one == two
    many = packing.pack(docs(spark, [(1, "a b")] * 300 + [(2, "c")]), p).collect()
    assert len({r.doc_id for r in many}) == 2 and len(many) >= 301 and len({r.sequence_id >> 32 for r in many}) > 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(i, t) for i, t in enumerate(ODD)], [(7, "word " * 9000), (7, "word " * 9000), (None, "x")], [(i, "some words " * (i * 13 % 700)) for i in range(150)]])
def test_packing_covers_each_id_once(spark, library, rows):
    p = packing.PackParams(tokenizer_file(), group_docs=40, with_ids=True)
    pieces = packing.pack(docs(spark, rows), p).collect()
    want = sorted(([*library(t), 1] for _, t in rows), key=lambda x: (len(x), x))
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        bins[r.sequence_id].append(r)
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    assert sum(r.length for r in pieces) == sum(map(len, want))
    if len({k for k, _ in rows}) == len(rows):
        for k, t in rows:
            ids = [*library(t), 1]
            own = sorted(by_doc[(k, len(ids))], key=lambda r: r.start)
            assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
    empty = 0
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own]).tolist()
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= p.length
        empty += 0 if ends[-1] & (ends[-1] - 1) == 0 else p.length - ends[-1]
    assert empty <= 15 * len(bins)


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 300).tolist()
    free, want = [], []
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(100)
            want.append([])
        free[at] -= sizes[i]
        want[at].append(i)
    assert packing.first_fit_decreasing(sizes, 100) == want
