import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from techatlas.llm import minhash, queries
from techatlas.llm.shared import components, numbered

from . import brute


def documents(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, brute.DOCS)


def skewed(seed):
    """Exact copies, near copies in chains, short, empty and null texts, one very long text."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    out = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(1, 60)))) for k in range(60)]
    base = rnd.choices(vocab, k=80)
    out += [(100 + k, " ".join(base)) for k in range(40)]
    for k in range(60):
        base = list(base)
        base[rnd.randrange(80)] = rnd.choice(vocab)
        out.append((200 + k, " ".join(base)))
    long = " ".join(rnd.choices(vocab, k=20000))
    return out + [(300, ""), (301, None), (302, " \n\t"), (303, "One"), (304, "one"), (305, long), (306, long + " x")]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    texts = skewed(size)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts), size).collect()}
    want = brute.roots([i for i, _ in texts], brute.near_links(texts, size, 80))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(brute.shingle_set(t, size)) for i, t in texts}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_query_equals_brute_force_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op10_minhash"](spark, sf).collect()}
    assert got == brute.roots([i for i, _ in texts], brute.near_links(texts, 2, 80))


def test_repeated_rows_nameless_rows_and_empty_table(spark):
    t = "a b c d e f g h"
    texts = [(1, t), (1, t), (2, t), (None, t), (3, "x y z u v w"), (3, t), (4, "x y z u v w")]
    df = documents(spark, texts).withColumn("bucket", F.lit(1)).withColumn("id", F.lit("x")).withColumn("__hash", F.lit(7)).withColumn("__kept", F.lit(8))
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect() if r["doc_id"])
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 1, False)]
    kept = minhash.one_per_group(df)
    assert kept.columns == df.columns
    assert {(r["__hash"], r["__kept"]) for r in kept.collect()} == {(7, 8)}
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.one_per_group(df.limit(0)).count() == 0


def test_estimate_is_unbiased():
    rnd = np.random.default_rng(5)
    errors = []
    for j in (0.5, 0.8, 0.95):
        for _ in range(60):
            shared, own = int(300 * j), 300 - int(300 * j)
            pool = rnd.integers(0, 2**63, 300 + own, dtype=np.uint64)
            a, b = pool[:300], np.concatenate([pool[:shared], pool[300:]])
            sigs = minhash.unpacked([minhash.packed(minhash.minima(x)) for x in (a, b)])
            errors.append(minhash.estimates(sigs, sigs)[0, 1] - shared / (300 + own))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25


def test_tiles_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 700)
    texts = skewed(9)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts), 2).collect()}
    assert got == brute.roots([i for i, _ in texts], brute.near_links(texts, 2, 80))


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(3)
    order = rnd.sample(range(500), 500)
    links = list(zip(order[:200], order[1:201])) + [(order[210], x) for x in order[211:400]] + [(7, 7)]
    links += [(order[400], order[401])] * 5
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    want = brute.roots({v for p in links if p[0] != p[1] for v in p}, links)
    assert got == want


def test_numbers_are_gapless_in_hot_groups(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5))
    rows = numbered(df.repartition(7), ["g"], "slot").collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 3000
