import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from techatlas.llm import queries, spaced

from . import brute

BENCHMARK = "item_id long, text string"


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def plain(docs, items):
    """All alignments of all texts with all items: places of the rows of docs, and item ids."""
    number = {}

    def codes(text):
        return np.array([number.setdefault(w, len(number)) for w in words(text)], np.int64)

    others = [(i, codes(item)) for i, item in items]
    out = set()
    for d, text in docs:
        own = codes(text)
        for i, other in others:
            n = min(spaced.RUN, len(other))
            if not n or len(own) < n:
                continue
            equal = own[:, None] == other
            rows, columns = len(own) - n + 1, len(other) - n + 1
            matched = sum(equal[k : k + rows, k : k + columns].astype(int) for k in range(n))
            if matched.max() >= n - 2 * n // 13:
                out.add((d, i))
    return out


def test_masks_find_every_overlap():
    """Whichever words of a stretch are replaced, one mask has a place without any."""
    for gone in itertools.combinations(range(spaced.RUN), spaced.SUBSTITUTIONS):
        assert any(
            not any(mask[k - at] == "1" for k in gone if 0 <= k - at < len(mask))
            for mask in spaced.MASKS
            for at in range(spaced.RUN - len(mask) + 1)
        )


def test_masks_of_short_items_find_every_overlap():
    for n in range(1, spaced.RUN):
        for gone in itertools.combinations(range(n), spaced.tolerance(n)):
            assert any(len(m) == n and not any(m[k] == "1" for k in gone) for m in spaced.short_masks(n))


def fixture(seed):
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(4, 40)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "too few words"), (33, items[3][1]), (34, "Alone!"), (35, "v1 v2"), (33, "v3 v4 v5 v6 v7 v8 v9"), (None, " ".join(rnd.choices(vocab, k=20)))]
    docs = []
    for d in range(150):
        w = rnd.choices(vocab, k=rnd.randint(0, 80))
        if d % 3 == 0:
            part = words(rnd.choice(items)[1])
            for _ in range(d % 5):
                if part:
                    part[rnd.randrange(len(part))] = "other"
            low = rnd.randrange(len(w) + 1)
            w[low:low] = part[rnd.randrange(3) :]
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(w).title()))
    docs += [(600, "not alone here"), (601, "there are too few words, he said"), (602, "a v3 v4 v5 other v7 v8 v9 b"), (603, "a v3 v4 v5 other other v8 v9 b")]
    docs += [(500, None), (501, ""), (None, items[0][1] + " " + items[1][1]), (5, docs[0][1]), docs[0], (502, ("x " * 9000) + items[2][1] * 2)]
    return docs, items


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_overlaps_equal_plain_alignment(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spaced, "BROADCAST_SEEDS", broadcast)
    docs, items = fixture(7)
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], brute.DOCS).selectExpr("*", "1 as item_id", "2 as at", "3 as own")
    bench = spark.createDataFrame(items, BENCHMARK).selectExpr("*", "1 as seed", "'x' as words")
    got = {(r["doc_id"], r["item_id"]) for r in spaced.overlaps(df.repartition(3), bench).collect()}
    want = plain(docs, items)
    assert got == want and len(want) > 20
    assert {(600, 34), (601, 32), (602, 33)} <= got and (603, 33) not in got
    df = df.selectExpr("*", "7 as __hash", "8 as __id", "9 as ___id")
    clean = spaced.clean_rows(df, bench)
    assert clean.columns == df.columns
    assert {tuple(r) for r in clean.select("__hash", "__id", "___id").distinct().collect()} == {(7, 8, 9)}
    bad = {k for k, _ in plain([(k, t) for k, (_, t) in enumerate(docs)], items)}
    left = [d for k, (d, _) in enumerate(docs) if k not in bad]
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted(left, key=repr)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 1)], brute.DOCS)
    none = spark.createDataFrame([], BENCHMARK)
    assert spaced.overlaps(df, none).count() == 0 and spaced.clean_rows(df, none).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], BENCHMARK)
    assert spaced.overlaps(df.limit(0), some).count() == 0 and spaced.overlaps(df, some).count() == 1


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_spaced_seeds"](spark, sf).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got == plain(docs, items)


def test_no_python_in_the_plan(spark):
    docs, items = fixture(1)
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string")
    found = spaced.clean_rows(df, spark.createDataFrame(items, BENCHMARK)).select(F.count(F.lit(1)))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


def test_hits_and_texts_are_never_broadcast(spark):
    """Both grow with the corpus, and their files are far smaller than what they are in memory."""
    docs, items = fixture(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plan = spaced.overlaps(df, spark.createDataFrame(items, BENCHMARK))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "text_hash" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
