import numpy as np

import corpus_pipeline as cp
from techatlas.llm import spans
from techatlas.llm.queries import tokenizer_path

from . import brute, test_spaced
from .test_packing import expected

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(cp.materialize(stage(spark, seen[-1], SF), "test"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    rows = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in seen[:-1]]
    toxic, near, cut, clean = rows[1:]
    assert set(toxic) <= set(rows[0]) and all(toxic[i] == rows[0][i] for i in toxic)
    roots = brute.roots(toxic, brute.near_links(list(toxic.items()), 5, 80))
    assert near == {i: t for i, t in toxic.items() if roots[i] == i}
    assert set(cut) == set(near) and any(cut[i] != near[i] for i in cut)
    assert all(len(cut[i]) <= len(near[i]) for i in cut)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {i for i in cut if i not in clean}
    assert {i for i, _ in test_spaced.plain([(i, cut[i]) for i in gone], bench)} == gone
    assert all(clean[i] == cut[i] for i in clean)
    ids = {}
    for r in seen[-1].orderBy("doc_id", "start").collect():
        ids.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert ids == dict(zip(clean, expected(clean.values())))


def test_run_gives_the_last_stage(spark):
    got = cp.run(spark, SF)
    assert got.count() > 200 and {"doc_id", "start", "length", "ids"} <= set(got.columns)
