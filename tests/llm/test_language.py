import math
import random

import numpy as np
import pandas as pd
import pytest

from techatlas.llm import language, queries

from . import brute


def train(texts):
    """Window counts as the task makes them."""
    import pyarrow as pa

    batch = pa.record_batch([pa.array([x for x, _ in texts]), pa.array([t for _, t in texts], pa.binary())], names=["lang", "text"])
    rows = [r for b in language._count([batch]) for r in b.to_pylist()]
    langs = sorted({r["lang"] for r in rows})
    keys = [np.array(sorted(r["key"] for r in rows if r["lang"] == x)) for x in langs]
    by = {(r["lang"], r["key"]): r["n"] for r in rows}
    return langs, language.Trees(langs, keys, [np.array([by[x, k] for k in ks]) for x, ks in zip(langs, keys)])


def plain(texts, order):
    """Prediction by partial matching with exclusion, by recursion."""
    seen = {}
    for t in texts:
        t = b"\0" * order + t
        for k in range(order, len(t)):
            for n in range(order + 1):
                c = seen.setdefault(t[k - n : k], {})
                c[t[k]] = c.get(t[k], 0) + 1

    def p(s, h):
        if h not in seen:
            return p(s, h[1:]) if h else 1 / 256
        c = seen[h]
        total, kinds = sum(c.values()), len(c)
        if s in c:
            return c[s] / (total + kinds)
        lower = (lambda x: p(x, h[1:])) if h else (lambda x: 1 / 256)
        return kinds / (total + kinds) * lower(s) / (1 - sum(lower(x) for x in c))

    def bits(t):
        t = b"\0" * order + t
        return -sum(math.log2(p(t[k], t[k - order : k])) for k in range(order, len(t)))

    return bits


def test_code_lengths_equal_recursion(monkeypatch):
    rnd = random.Random(6)

    def make(alphabet, n):
        return bytes(rnd.choice(alphabet) for _ in range(n))

    texts = [("x", make(b"abcd ", 300)), ("x", make(b"abc ", 90)), ("y", make(b"cdef\xc3\xa9 ", 250)), ("y", b""), ("z", b"a")]
    langs, trees = train(texts)
    tests = [b"", b"a", make(b"abcdef ", 200), b"zzz\xff\x00a", make(b"abcdefgh\xc3", 500), b"ab"]
    want = [[plain([t for x, t in texts if x == lang], language.ORDER)(t) for lang in langs] for t in tests]
    for size in (7, 64, 1 << 19):
        monkeypatch.setattr(language, "BYTES_AT_ONCE", size)
        assert trees.lengths(tests) == pytest.approx(np.array(want), rel=1e-4, abs=1e-3)


def test_rows_and_edges(spark):
    en, de = "the cat and the dog ran to the house ", "der hund und die katze liefen in das haus "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(100, None, "en", "s", 0), (101, "", None, "s", 0), (102, "12 + 3!", "en", "s", 0), (103, "THE DOG", None, "s", 0)]
    rows += [(None, "die katze", "de", "s", 0), (1, rows[1][1], "en", "s", 1), (104, en * 5000, "en", "s", 1)]
    df = spark.createDataFrame(rows, brute.DOCS).selectExpr("*", "1 as key", "'x' as lang_pred", "0.5 as score")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert by[103]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[104]["lang_pred"] == "en"
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(df.limit(0)).count() == 0
    none = language.identify(df.withColumn("lang", df["lang_pred"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_held_out_accuracy_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_language"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    got = got[got["held_out"] & (got["lang_pred"] != "und")]
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
