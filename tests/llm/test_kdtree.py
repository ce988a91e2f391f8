import random
import zlib

import pytest

from techatlas.llm import kdtree, queries

from . import brute


def fixture(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        text = "é" * rnd.randint(0, 30) + "w" * int(rnd.paretovariate(1.2) * 20 % 4000)
        rows.append((i, text, rnd.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 50}", 1))
    rows += [(5000 + k, "same text " * 20, "en", "hot", 1) for k in range(1500)]  # a third of all rows are equal
    return [*rows, (9000, None, "en", None, 0), (9001, "", None, "s1", 0), (None, "nameless", "en", "s1", 0), rows[7], rows[7]]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(spark, shards):
    rows = fixture(shards)
    df = spark.createDataFrame(rows, brute.DOCS).selectExpr("*", "1 as node", "2 as cut", "3 as slot", "4 as tie")
    got = kdtree.shard(df.repartition(5), shards=shards).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(shards))
    total = sum(sizes.values())
    assert max(abs(s - total / shards) for s in sizes.values()) <= 4100 * 2 + total * 0.002
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_leaves_reach_the_target(spark):
    df = spark.createDataFrame(fixture(5), brute.DOCS)
    got = kdtree.shard(df, leaf_bytes=100_000).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in got)
    assert len(got) == -(-total // 100_000) and max(r[1] for r in got) <= 100_000 + 8200 + total * 0.002


def test_cuts_follow_metadata(spark):
    """Two sources of equal size, all else equal: each gets a shard of its own."""
    rows = [(i, "x" * 50, "en", "ab"[i % 2], 50) for i in range(1000)]
    got = kdtree.shard(spark.createDataFrame(rows, brute.DOCS), shards=2).collect()
    assert len({(r["doc_id"] % 2, r["shard"]) for r in got}) == 2


def test_few_rows_empty_table_and_query(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "a", "en", "s", 1)], brute.DOCS)
    assert kdtree.shard(df, shards=8).count() == 2
    assert kdtree.shard(df.limit(0), shards=8).count() == 0
    got = queries.QUERIES["op9_kd_tree"](spark, "/root/testdata/sf0.01").toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.03 * sizes.mean()


@pytest.mark.parametrize("row", [(7, "same text", "en", "s", 1), (None, None, None, None, None)])
def test_equal_rows_are_spread(spark, row):
    got = kdtree.shard(spark.createDataFrame([row] * 1000, brute.DOCS), shards=4).groupBy("shard").count().collect()
    assert len(got) == 4 and all(abs(r["count"] - 250) <= 25 for r in got)
