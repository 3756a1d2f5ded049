"""Cross-tokenizer alignment against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vagari.llm.alignment import align, aligner, common_cuts
from vagari.llm.bpe import _byte_chars

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
TEXTS = [None, "", " ", "a", "a ", "  two  spaces ", "hi <|endoftext|> there", "<s> <0x41> </s>", "tab\tand\nline \n ends", "a▁b", "▁", "日本語 テスト。", "\U0001f600\U0001f601 ok", "x  y　 z", "the cat and the cat's hat, the 12345 hats.", "aaaa" * 300, "un­soft", "é é ﬁ", "\x00 nul", "​ zero"]


@pytest.fixture(scope="module")
def plain():
    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    back = {chr(c): i for i, c in enumerate(_byte_chars())}

    def piece(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text, num_threads=1)
        x, y = [bytes(back[c] for c in ta.id_to_token(i)) for i in a], [piece(i) for i in b]
        if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            return []
        ea, eb = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            u, v = ea.index(end) + 1, eb.index(end) + 1
            out.append((a[i:u], b[j:v]))
            i, j = u, v
        return out

    return groups


def expected(rows, groups):
    found = [(k, groups(t)) for k, t in rows]
    links = [[(a, b) for x, y in g for a in x for b in y] for _, g in found]
    count = Counter(p for own in links for p in set(own))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    for (k, g), own in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        yield k, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), sha


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_equals_plain_version(spark, plain):
    rows = list(enumerate(TEXTS)) + [(None, "the cat sat"), (3, "the cat sat"), (3, "the cat sat"), (None, None)]
    assert order(align(spark.createDataFrame(rows, SCHEMA), A, B).collect()) == order(expected(rows, plain))


def test_given_documents_equal_plain_version(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert order(align(docs.repartition(5), A, B).collect()) == order(expected(rows, plain))


def test_empty_table(spark):
    assert align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t'.,sSé 　 2×ñ日▁<>"), max_size=14), max_size=4))
def test_groups_of_any_text(plain, texts):
    al = aligner(A, B)
    buf = "".join(" " + t if t else "" for t in texts).encode()
    offs = np.cumsum([0] + [len((" " + t).encode()) if t else 0 for t in texts])
    seq, size, n_a, n_b = al.align(np.frombuffer(buf, np.uint8), offs)
    got = np.split([al.ids[g] for g in seq], np.cumsum(size)[:-1]) if texts else []
    want = [[f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain(t)] for t in texts]
    assert [list(g) for g in got] == want
    assert n_a.tolist() == [sum(len(x) for x, _ in plain(t)) for t in texts]
    assert n_b.tolist() == [sum(len(y) for _, y in plain(t)) for t in texts]


def test_common_cuts():
    assert common_cuts([1, 2, 3], [3, 3]) == [(2, 1), (3, 2)]
    assert common_cuts([4], [1, 1, 2]) == [(1, 3)]
    assert common_cuts([], []) == []
