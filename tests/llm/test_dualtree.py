import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from techatlas.llm import dualtree

from . import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(brute.ASCII_LOWER))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_all, l_all = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        own = set(terms(text))
        found = []
        for i, c, n in counts:
            m = 100 - 50 + 50 * n * n_all // l_all
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in own
                if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def tables(seed):
    rnd = random.Random(seed)
    words = ["w%d" % k for k in range(120)] + ["Ärger", "ärger", "中文", "x1y2", "ABC", "abc"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: rnd.choice([" ", "-", "\n", "."]).join(rnd.choices(words, weights, k=n))
    docs = [(k, text(rnd.choice([0, 1, 3, 10, 40, 200]))) for k in range(400)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)] + [(2000, None), (2001, "..."), (2002, "w1 " * 30_000), docs[7], (None, docs[8][1]), (3, "w0 w9")]
    items = [(k, text(rnd.randint(1, 30))) for k in range(30)] + [(100, None), (101, "nowhere"), (102, docs[5][1]), (102, "w1"), (None, "w2 w3"), (5, "w4")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_scoring_all_pairs(spark, monkeypatch, small):
    docs, items = tables(3)
    if small:  # several blocks of items, deep trees
        for name, value in (("BLOCK_TERMS", 900), ("ITEM_LEAF", 2), ("DOC_LEAF", 4), ("TREE_DOCS", 64), ("FAN", 2)):
            monkeypatch.setattr(dualtree, name, value)
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], brute.DOCS).selectExpr("*", "1 as n", "2 as part", "3 as item")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as size", "8 as h", "9 as rank")
    got = sorted((tuple(r) for r in dualtree.search(d.repartition(3), i, k=50).collect()), key=repr)
    assert got == plain(docs, items, 50)


def _search(exact, docs, items):
    words = sorted({t for _, x in items for t in terms(x)})
    number = {w: k for k, w in enumerate(words)}
    def rows(texts, count):
        own = [Counter(terms(t)) for _, t in texts]
        own = [{number[t]: count(c[t]) for t in c if t in number} for c in own]
        start = np.concatenate([[0], np.cumsum([len(o) for o in own])])
        return dualtree.Sparse(start, np.array([k for o in own for k in o], np.int32), np.array([v for o in own for v in o.values()], np.int64))

    weight = np.arange(1, len(words) + 1) * 10
    left = rows(items, lambda c: 1)
    left.value = weight[left.idx]
    found = dualtree.Search(left, weight.astype(float), np.zeros(len(items), np.int64), 5)
    if not exact:
        found.number = np.int64
    found.add(np.arange(len(docs)), rows(docs, lambda c: 1000 * c))
    return found


def test_whole_numbers_and_doubles_give_the_same_and_bounds_prune():
    docs, items = tables(4)
    a, b = _search(True, docs, items), _search(False, docs, items)
    assert a.number is np.float64 and b.number is np.int64
    for x, y in zip(a.best, b.best, strict=True):
        assert x[0].tolist() == y[0].tolist() and x[1].tolist() == y[1].tolist()
    assert 0 < a.computed < len(docs) * len(items)


def test_nodes_hold_the_maxima_of_what_lies_below():
    rnd = np.random.default_rng(1)
    dense = rnd.integers(0, 50, (300, 40)) * (rnd.random((300, 40)) < 0.2)
    r, c = np.nonzero(dense)
    data = dualtree.Sparse(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=300))]), c.astype(np.int32), dense[r, c])
    todo, seen = [dualtree.tree(data, np.arange(300), 8, np.ones(40))], []
    while todo:
        node = todo.pop()
        top = np.zeros(40, np.int64)
        top[node.idx] = node.top
        assert (top == dense[node.rows].max(axis=0)).all()
        assert node.below or len(node.rows) <= 8
        assert not node.below or sorted(x for b in node.below for x in b.rows) == sorted(node.rows)
        seen += [] if node.below else node.rows.tolist()
        todo += node.below
    assert sorted(seen) == list(range(300))


def test_empty_tables(spark):
    docs, items = tables(5)
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], brute.DOCS)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert dualtree.search(d.limit(0), i).count() == 0
    assert dualtree.search(d, i.limit(0)).count() == 0
    assert dualtree.search(d, i.where("item_id = 101")).columns == ["item_id", "rank", "doc_id", "score"]
    assert dualtree.search(d, i.where("item_id = 100")).count() == 0
