"""Operators on skewed and larger generated input against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from techatlas.operators import actors as ac
from techatlas.operators import aggregate as ag
from techatlas.operators import growth as gr
from techatlas.operators import pairs as pr
from techatlas.operators import sampling as sa
from techatlas.operators import series as se


def hot_links(seed, groups=40, hot=90):
    """Small groups plus one that holds most members, twice the size of the block used below."""
    rnd = random.Random(seed)
    rows = set()
    for tech in ("t", "u"):
        for g in range(groups):
            for m in rnd.sample(range(120), rnd.randint(1, 7)):
                rows.add((tech, g, f"m{m:03d}"))
        for m in range(hot):
            rows.add((tech, 1000, f"m{m:03d}"))
            if m % 2:
                rows.add((tech, 1001, f"m{m:03d}"))
    return sorted(rows)


def brute_pairs(rows):
    members = defaultdict(list)
    for tech, g, m in rows:
        members[tech, g].append(m)
    n = Counter()
    for (tech, _), ms in members.items():
        for a, b in itertools.combinations(sorted(ms), 2):
            n[tech, a, b] += 1
    return n


@pytest.mark.parametrize("block", [3, 10, 64])
def test_pair_counts_exact_on_hot_groups(spark, block):
    rows = hot_links(1)
    df = spark.createDataFrame(rows, "tech string, g long, m string")
    got = {tuple(r)[:3]: r["n"] for r in pr.pair_counts(df, "g", "m", ["tech"], block).collect()}
    assert got == dict(brute_pairs(rows))


@pytest.mark.parametrize("k,block,seed", [(5, 8, 1), (40, 8, 2), (200, 8, 3), (3000, 8, 4), (40, 64, 5)])
def test_top_pairs_exact_on_hot_groups(spark, k, block, seed):
    rows = hot_links(seed)
    df = spark.createDataFrame(rows, "tech string, g long, m string")
    want = []
    for tech in ("t", "u"):
        mine = sorted(((-n, a, b) for (t, a, b), n in brute_pairs(rows).items() if t == tech))
        want += [(tech, a, b, -n) for n, a, b in mine[:k]]
    assert rows_of(pr.top_pairs(df, "g", "m", k, block)) == sorted(want, key=repr)


def test_ties_come_from_one_hot_group(spark):
    """All pairs occur once and sit in a single large group."""
    rows = [("t", 1, f"m{i:04d}") for i in range(300)]
    df = spark.createDataFrame(rows, "tech string, g long, m string")
    want = [("t", "m0000", f"m{i:04d}", 1) for i in range(1, 51)]
    assert rows_of(pr.top_pairs(df, "g", "m", 50)) == want


def reference_sample(years, target, threshold=5):
    """Plain allocation and midpoint picks on {year: population}."""
    total = sum(years.values())
    if total <= target:
        return dict(years)
    take = {y: n for y, n in years.items() if n <= threshold}
    rest = {y: n for y, n in years.items() if n > threshold}
    room = target - sum(take.values())
    if room <= 0:
        return {**take, **{y: 0 for y in rest}}
    exact = {y: room * n / sum(rest.values()) for y, n in rest.items()}
    for y in rest:
        take[y] = math.floor(exact[y])
    for y in sorted(rest, key=lambda y: (-(exact[y] - math.floor(exact[y])), y))[: target - sum(take.values())]:
        take[y] += 1
    return take


@pytest.mark.parametrize("target", [1, 3, 50, 333, 1000, 5000])
def test_sample(spark, target):
    pops = {2015: 3, 2016: 800, 2017: 41, 2018: 5, 2019: 6, 2020: 1200, 2021: 7}
    rows, i = [], 0
    for y, n in pops.items():
        for _ in range(n):
            i += 1
            rows.append(("t", y, i * 7))
    df = spark.createDataFrame(rows, "tech string, year int, id long")
    take = reference_sample(pops, target)
    want = []
    for y, n in pops.items():
        ids = [r[2] for r in rows if r[1] == y]
        t = take[y]
        picks = range(n) if t >= n else [int(n / t / 2 + j * (n / t)) for j in range(t)]
        want += [("t", y, ids[p]) for p in picks]
    got = rows_of(sa.stratified_sample(df, "id", target))
    assert got == sorted(want, key=repr)
    if target > 8:
        assert len(got) == min(target, len(rows))


def test_stratum_index_spans_ranges(spark):
    rnd = random.Random(3)
    hashed = [rnd.randrange(-(2**63), 2**63) for _ in range(3000)]
    for ids in (rnd.sample(range(10**12), 5000), hashed, [*range(3000), 2**62], [-(2**63), 2**63 - 1, *range(50)]):
        df = spark.createDataFrame([("t", i % 3, i) for i in ids], "tech string, year int, id long")
        got = {r["id"]: r["_idx"] for r in sa.stratum_index(df, "id").collect()}
        for y in range(3):
            assert [got[i] for i in sorted(i for i in ids if i % 3 == y)] == list(range(sum(i % 3 == y for i in ids)))


def test_nothing_is_cut_before_it_is_counted(spark):
    """More actors, countries and papers than any list shows."""
    rnd = random.Random(8)
    n_a = {f"A{k:03d}": rnd.randint(1, 40) for k in range(180)}
    n_o = {f"A{k:03d}": rnd.randint(1, 40) for k in range(90, 260)}
    a = spark.createDataFrame([("q", k, n) for k, n in n_a.items()], "tech string, actor string, n long")
    o = spark.createDataFrame([("q", k, "DE", n, False, False) for k, n in n_o.items()],
                              "tech string, name string, country string, n long, is_sme boolean, is_coordinator boolean")
    actors = ac.merge_actors(a, o)
    total = {k: n_a.get(k, 0) + n_o.get(k, 0) for k in {*n_a, *n_o}}
    best = sorted(total, key=lambda k: (-total[k], k))
    every = sum(total.values())
    assert ac.hhi(actors).first()["hhi"] == pytest.approx(sum(n * n for n in total.values()) / every**2 * 10000, abs=0.06)
    ranked = ac.rank_share(actors, None).orderBy("rank").collect()
    assert [r["name"] for r in ranked] == best and ranked[0]["share"] == round(total[best[0]] / every, 4)
    assert ac.top_share(ac.rank_share(actors, 20), actors).first()["top3_share"] == pytest.approx(sum(total[k] for k in best[:3]) / every, abs=1e-4)

    records = {r: rnd.sample(sorted(n_a), rnd.randint(1, 9)) for r in range(400)}
    projects = {p: rnd.sample(sorted(n_o), rnd.randint(1, 9)) for p in range(300)}
    ra = spark.createDataFrame([("q", r, x) for r, xs in records.items() for x in xs], "tech string, record_id long, actor string")
    po = spark.createDataFrame([("q", p, x) for p, xs in projects.items() for x in xs], "tech string, project_id long, name string")
    strong, want = set(best[:40]), Counter()
    for xs in [*records.values(), *projects.values()]:
        want.update(itertools.combinations(sorted(strong & set(xs)), 2))
    edges = ac.collab_edges(ra, po, actors, 40, None)
    assert {(r["source"], r["target"]): r["weight"] for r in edges.collect()} == dict(want)
    kinds = {r["name"]: r["type"] for r in ac.collab_nodes(edges, actors).collect()}
    assert kinds == {k: "both" if k in n_a and k in n_o else "patent" if k in n_a else "cordis" for k in {x for p in want for x in p}}

    one = spark.createDataFrame([("q", f"C{k:02d}", 30 - k) for k in range(30)], "tech string, country string, n long")
    two = spark.createDataFrame([("q", f"C{k:02d}", k) for k in range(30)], "tech string, country string, n long")
    assert all(r["total"] == 30 for r in ac.merge_countries(one, two).collect())

    cites = [rnd.randint(0, 700) for _ in range(900)]
    papers = spark.createDataFrame([("q", k, c, 0) for k, c in enumerate(cites)], "tech string, paper_id long, citations long, influential long")
    h = max(k for k in range(900) if sum(c >= k for c in cites) >= k)
    assert h > 200 and ag.h_index(papers).first()["h_index"] == h
    assert ag.impact_totals(papers).first()["papers"] == 900


def test_entrants_and_persisting_of_every_year(spark):
    rows = [("q", a, y, 1) for y, names in {2018: "AX", 2020: "ABC", 2021: "CD"}.items() for a in names]
    years = spark.createDataFrame(rows, "tech string, actor string, year int, n long")
    assert rows_of(ac.entrants_except(years)) == [("q", 2020, "B"), ("q", 2020, "C"), ("q", 2021, "D")]
    assert rows_of(ac.persisting_intersect(years)) == [("q", 2020, "A"), ("q", 2021, "C")]


def test_growth_curves(spark):
    def logistic(x):
        return 1000 / (1 + math.exp(-0.5 * (x - 2010)))

    def gompertz(x):
        return 500 * math.exp(-math.exp(-0.3 * (x - 2008)))

    rows = [("log", y, logistic(y)) for y in range(2000, 2021)]
    rows += [("gom", y, gompertz(y)) for y in range(2000, 2021)]
    rows += [("real", 2015 + i, float(v)) for i, v in enumerate([5, 12, 25, 50, 95, 170, 290, 450, 640, 830, 1000])]
    rows += [("short", 2015, 1.0), ("short", 2016, 2.0), ("zero", 2015, 0.0), ("zero", 2016, 0.0), ("zero", 2017, 0.0)]
    fits = gr.growth_curve_fit(spark.createDataFrame(rows, "tech string, year int, cumulative double"))
    best = {r["tech"]: r for r in gr.growth_model_select(fits).collect()}
    assert set(best) == {"log", "gom", "real"}
    assert best["log"]["model"] == "Logistic" and best["gom"]["model"] == "Gompertz"
    assert abs(best["log"]["sat"] - 1000) < 1 and abs(best["log"]["x0"] - 2010) < 0.05 and best["log"]["r2"] > 0.9999
    assert abs(best["gom"]["sat"] - 500) < 1 and abs(best["gom"]["k"] - 0.3) < 0.002
    assert best["real"]["r2"] > 0.99 and 0 < best["real"]["maturity_percent"] <= 100


def test_phases(spark):
    def phase(counts):
        df = spark.createDataFrame([("t", 2000 + i, c) for i, c in enumerate(counts)], "tech string, year int, n long")
        r = se.heuristic_phase(se.trend_features(df)).first()
        return r["phase"], r["confidence"]

    assert phase([1, 2]) == ("Unknown", 0.0)
    assert phase([0, 0, 0]) == ("Unknown", 0.0)
    assert phase([1, 2, 4, 8, 16, 32])[0] == "Emerging"
    assert phase([50, 51, 50, 49, 50, 51])[0] == "Mature"
    assert phase([100, 90, 70, 40, 20, 10])[0] == "Declining"
    limits = spark.range(1).select(*[se.maturity_phase(F.lit(float(v))).alias(str(v)) for v in (9.99, 10, 49.99, 50, 89.99, 90)]).first()
    assert list(limits) == ["Emerging", "Growing", "Growing", "Mature", "Mature", "Saturation"]


def test_series(spark, ask):
    terms = ask(("t", "t", 2000, 2003))
    s = spark.createDataFrame([("t", 2000, 4), ("t", 2002, 6), ("t", 2009, 1)], "tech string, year int, n long")
    none = s.where("false")
    got = se.yoy_growth(se.merge_series(terms, s, none, none), ["records"]).orderBy("year").collect()
    assert [(r["year"], r["records"], r["records_growth"]) for r in got] == [(2000, 4, None), (2001, 0, -100.0), (2002, 6, None), (2003, 0, -100.0)]
    assert [r["cumulative"] for r in se.cumulative(se.spine_left_join(terms, s)).orderBy("year").collect()] == [4, 4, 10, 10]
