"""Fill-in-middle against a plain version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vagari.llm.fill_middle import FillParams, fill_digest, fill_in_middle, restored

SCHEMA = "doc_id long, text string"
TEXTS = [None, "", "a", " ", "abc def", "a<P>b", "x <S> y", "<M>", "<", "a <<< b> >", "été naïve日本語 \U0001f600 ok\n\nend", "\t\n", "word " * 700, "x" * 5000, "1234567890" * 200, "<S", "<P> "]


def plain(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("units", [1, 3, 256])
def test_equals_plain_version(spark, units):
    rows = [(i * 10 + k, t) for i, t in enumerate(TEXTS) for k in range(6)] + [(None, "no key at all"), (None, None), (7, "again"), (7, "again"), (7, "another")]
    got = fill_in_middle(spark.createDataFrame(rows, SCHEMA), FillParams(run_units=units)).collect()
    assert order(map(tuple, got)) == order(plain(*r) for r in rows)


def test_texts_come_back(spark):
    rows = [(i * 100 + k, t) for i, t in enumerate(TEXTS) for k in range(20)]
    out = fill_in_middle(spark.createDataFrame(rows, SCHEMA)).withColumn("back", restored(F.col("output"), F.col("form")))
    assert {(r.doc_id, r.back) for r in out.collect()} == {(k, t or "") for k, t in rows}
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}


def test_empty_table_and_other_columns(spark):
    assert fill_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, "one two", "x", 3)], SCHEMA + ", body string, id int")
    got = fill_digest(rows).collect()[0]
    assert (got.doc_id, got.n, got.restored_sha256) == (1, 3, hashlib.sha256(b"one two").hexdigest())


def test_texts_are_shuffled_once(spark):
    from vagari.llm.queries import op11_fill_in_middle

    df = op11_fill_in_middle(spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") == 1
    assert "Python" not in final
