import random

import numpy as np
import pytest

from techatlas.llm import embeddings, queries

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.93):
    good = []
    for i, e, label in rows:
        ok = label is not None and i is not None and e is not None and None not in e
        e = np.array(e, np.float32).astype(np.float64) if ok else None
        if ok and np.isfinite(e).all() and e.any():
            good.append((i, e, label))
    links, n = set(), {}
    for k, (i, e, label) in enumerate(good):
        for m, (j, f, other) in enumerate(good):
            if k != m and label == other and len(e) == len(f):
                if e @ f / (np.linalg.norm(e) * np.linalg.norm(f)) >= threshold:
                    n[k] = n.get(k, 0) + 1
                    if i != j:
                        links.add((i, j))
    root = brute.roots({i for i, _, _ in rows if i is not None}, links)
    counts = [(i, n.get(k, 0), root[i]) for k, (i, _, _) in enumerate(good)]
    rest = list(rows)
    for i, _, _ in good:
        for r in rest:
            if r[0] == i and r[1] is not None and r[2] is not None:
                rest.remove(r)
                break
    return sorted([*counts, *((i, 0, root.get(i)) for i, _, _ in rest)], key=repr)


def fixture(seed, dim=12):
    rnd = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(40 if label else 5):
            base = rnd.normal(size=dim)
            for _ in range(rnd.integers(1, 5)):
                rows.append((k, [float(x) for x in base + rnd.normal(size=dim) * rnd.choice([0, 0.1, 0.25, 0.35])], label))
                k += 1
    rows += [(1000 + c, rows[0][1], 0) for c in range(30)] + [(1100, rows[0][1], 1), (1101, rows[0][1], None)]
    rows += [(1200, [0.0] * dim, 0), (1201, None, 0), (1202, [float("nan")] + [1.0] * (dim - 1), 0), (1203, [None] + [1.0] * (dim - 1), 0)]
    rows += [(1204, [float("inf")] * dim, 0), (1205, [2 * x for x in rows[0][1]], 0), (1206, rows[0][1][:5], 0), (1207, [], 0)]
    rows += [(None, rows[0][1], 0), (5, rows[20][1], 1), rows[3], (1208, [1e-30 * x for x in rows[0][1]], 0), (1209, [-x for x in rows[0][1]], 0)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [7, 1024])
def test_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = fixture(3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tile", "2 as key", "3 as x", "4 as usable")
    got = embeddings.near_duplicates(df.repartition(3)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == plain(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["component_id"] == r["vec_id"]) for r in got)


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(size=(300, 64)), rnd.normal(size=(300, 64))
    qx, sx, lx, ex = embeddings.quantised(x)
    qy, sy, _, ey = embeddings.quantised(y)
    near = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy
    true = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    bound = lx[:, None] * ey + ex[:, None]
    assert (np.abs(near - true) <= bound + 1e-12).all() and bound.max() < 0.05


def test_query_and_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.QUERIES["op6_int8_tiles"](spark, sf).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == plain(rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_columns_are_compared_as_given(spark):
    """Cosines within 2e-8 of the threshold, components beyond and below single precision."""
    rows = []
    for k in [*range(-20, 0), *range(1, 21)]:
        c = 0.93 + k * 1e-9
        rows += [(100 + 2 * k, [1.0, 0.0], k), (101 + 2 * k, [c, (1 - c * c) ** 0.5], k)]
    rows += [(900, [1e300, 1e299], 99), (901, [1e-300, 1e-301], 99), (902, [1e300, -1e300], 99)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    want = {i: int(k > 0) for i, _, k in rows if k != 99} | {900: 1, 901: 1, 902: 0}
    assert got == want
