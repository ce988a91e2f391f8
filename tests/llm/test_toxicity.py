import random
import zlib

import numpy as np
import pandas as pd

from techatlas.llm import queries, toxicity

from . import brute

LABELS = "doc_id long, quality int, toxic int"


def test_machine_learns_pairs_that_weights_cannot():
    """Toxic only where an insult meets a group; either alone is harmless."""
    rnd = random.Random(1)
    texts, labels = [], []
    for _ in range(4000):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        own = [100] * insult + [200] * group + rnd.sample(range(1000, 1400), 20)
        texts.append(np.array(sorted(own), np.int64))
        labels.append(float(insult and group))
    machine = toxicity.fit(texts[:3000], np.array(labels[:3000]))
    got = machine.scores(texts[3000:]) >= 0.5
    assert (got == np.array(labels[3000:])).mean() > 0.97


def test_scores_equal_the_formula():
    rnd = np.random.default_rng(2)
    m = toxicity.Machine(0.3, np.array([3, 7, 9]), rnd.normal(size=3), rnd.normal(size=(3, 2)))
    for t in ([], [3], [3, 9], [1, 3, 7, 9], [5]):
        at = [k for k, s in enumerate(m.slots) if s in t]
        y = m.bias + sum(m.weights[k] for k in at)
        y += sum(m.vectors[a] @ m.vectors[b] for i, a in enumerate(at) for b in at[i + 1 :])
        assert np.isclose(m.scores([np.array(t, np.int64)])[0], 1 / (1 + np.exp(-y)))


def fixture(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))] + ["vile", "rotten"] * bad
        rnd.shuffle(w)
        docs.append((i, " ".join(w), "en", "s", 1))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 0, int(bad)))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, "vile rotten w1", "en", "s", 3), (2002, "Vile, ROTTEN! " * 9000, "en", "s", 1)]
    docs += [docs[5], docs[5]]
    labels += [(0, 1, 0), (2000, 0, None), (None, 0, 1), (12345, 0, 1)]  # a second label, nulls, no document
    return spark.createDataFrame(docs, brute.DOCS), spark.createDataFrame(labels, LABELS), docs


def test_rows_edges_and_accuracy(spark):
    df, labels, docs = fixture(spark)
    df = df.selectExpr("*", "1.0 as score", "0 as toxic", "5 as terms")
    got = toxicity.score(df, labels).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((d[0] for d in docs), key=repr)
    by = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    for i in range(900):
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert np.mean([by[i]["predicted"] == int(i % 6 == 0) for i in range(900) if by[i]["held_out"]]) > 0.98
    assert by[2000]["score"] == by[2001]["score"] < 0.7 and by[2002]["predicted"] == 1
    clean = toxicity.clean_rows(df, labels)
    assert clean.columns == df.columns
    kept = [r["doc_id"] for r in clean.collect()]
    assert 2002 not in kept and kept.count(5) == 3 and {2000, 2001} <= set(kept)


def test_nothing_to_learn_from(spark):
    df, labels, _ = fixture(spark)
    assert {r["predicted"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0}
    assert toxicity.score(df.limit(0), labels).count() == 0
    assert toxicity.clean_rows(df.limit(0), labels).count() == 0


def test_held_out_accuracy_on_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op2_toxicity"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    got = got[got["held_out"]]
    assert got[got["predicted"] == 1]["toxic"].mean() > 0.97
    assert got[got["toxic"] == 1]["predicted"].mean() > 0.8
