"""Known answers for the small patent and project tables."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from techatlas.operators import actors as ac
from techatlas.operators import aggregate as ag
from techatlas.operators import codes as co
from techatlas.operators import match as ma
from techatlas.operators import normalize as no
from techatlas.operators import pairs as pr
from techatlas.operators import series as se


@pytest.fixture(scope="module")
def quantum(patents, ask):
    return ma.match_phrase(patents, ask(("quantum",)), ["title", "codes"], patents.columns, "pub_year")


def test_phrase(patents, ask):
    def found(q, **kw):
        m = ma.match_phrase(patents, ask((q, q, None, None)), ["title", "codes"], ["publication_number"])
        return [r[1] for r in rows_of(m)]

    assert found("quantum computing") == ["EP1001", "EP1009"]
    assert found("computing quantum") == []
    assert found("Quantum-Computing!") == ["EP1001", "EP1009"]
    assert found("g06n10 00") == ["EP1001", "EP1002", "EP1003", "EP1004", "EP1009", "EP1010"]
    assert found("device g06n10") == []  # not across fields


def test_prefix_and_all_terms(patents, ask):
    p = ma.match_prefix(patents, ask(("quantum comp",)), ["title"], ["publication_number"])
    assert [r[1] for r in rows_of(p)] == ["EP1001", "EP1009"]
    p = ma.match_prefix(patents, ask(("sol",)), ["title"], ["publication_number"])
    assert [r[1] for r in rows_of(p)] == ["EP1005", "EP1006"]
    a = ma.match_all_terms(patents, ask(("computing quantum",)), ["title"], "record_id")
    assert [r[1] for r in rows_of(a)] == [1, 9]


def test_many_terms_give_the_same(patents, ask, monkeypatch):
    terms = ask(("quantum",), ("quantum computing",), ("solar cell",), ("computing device",), ("none",))
    few = rows_of(ma.match_phrase(patents, terms, ["title", "codes"], ["record_id"]))
    all_few = rows_of(ma.match_all_terms(patents, terms, ["title"], "record_id"))
    monkeypatch.setattr(ma, "MANY", 0)
    assert rows_of(ma.match_phrase(patents, terms, ["title", "codes"], ["record_id"])) == few
    assert rows_of(ma.match_all_terms(patents, terms, ["title"], "record_id")) == all_few
    # one technology in a batch is the same as alone
    alone = rows_of(ma.match_phrase(patents, ask(("solar cell",)), ["title", "codes"], ["record_id"]))
    assert alone == [r for r in few if r[0] == "solar cell"]


def test_counts(quantum):
    assert rows_of(ag.records_by_year(quantum)) == [("quantum", y, 2) for y in (2020, 2021, 2022, 2023)]
    assert rows_of(ag.records_by_country(quantum)) == [("quantum", "DE", 4), ("quantum", "FR", 2), ("quantum", "US", 2)]
    assert sum(r[2] for r in rows_of(ag.families_by_year(quantum))) == 8


def test_year_window(patents, ask):
    m = ma.match_phrase(patents, ask(("q", "quantum", 2021, 2022)), ["title"], ["record_id", "pub_year"], "pub_year")
    assert m.count() == 4


def test_undated_rows_count_only_without_bounds(spark, ask):
    df = spark.createDataFrame([(1, "blue", None), (2, "blue", 2000)], "record_id long, title string, pub_year int")

    def n(start, end):
        return ma.match_phrase(df, ask(("b", "blue", start, end)), ["title"], ["record_id", "pub_year"], "pub_year").count()

    assert (n(None, None), n(1999, None), n(None, 1999)) == (2, 1, 0)


def test_families_fall_back_to_records(spark):
    df = spark.createDataFrame([("t", 1, 2000, None), ("t", 2, 2000, None)], "tech string, record_id long, pub_year int, family_id string")
    assert rows_of(ag.families_by_year(df)) == [("t", 2000, 2)]


def test_actor_names_and_links(patents, quantum):
    links = no.actor_links(patents)
    top = ag.top_actors(ag.record_actors(quantum.select("tech", "record_id", "pub_year"), links))
    got = {r["actor"]: r["n"] for r in top.collect()}
    assert got == {"SIEMENS": 3, "THALES": 2, "GOOGLE": 1, "IBM": 1, "SAP": 1}
    assert ag.records_without_link(patents, links.where("record_id < 9")).first()[0] == 2
    assert no.new_actor_links(patents, links.where("record_id < 9")).count() == 2


def test_co_applicants(spark):
    links = spark.createDataFrame(
        [("q", 1, "SIEMENS"), ("q", 1, "BOSCH"), ("q", 2, "SIEMENS"), ("q", 3, "THALES"), ("q", 4, "BOSCH")],
        "tech string, record_id long, actor string",
    )
    assert rows_of(pr.pairs_actors(links)) == [("q", "BOSCH", "SIEMENS", 1)]


def test_last_full_year(patents, spark):
    assert ag.last_full_year(patents, "pub_date").first()[0] == 2022
    late = spark.createDataFrame([("2022-11-15",), ("2021",), ("x",)], "pub_date string")
    assert ag.last_full_year(late, "pub_date").first()[0] == 2022


def test_projects(project_rows, ask):
    projects, orgs = project_rows
    pm = ma.match_phrase(projects, ask(("quantum",)), ["title"], projects.columns, "start_year")
    po = ag.project_orgs(pm.select("tech", "project_id", "start_year", "framework"), orgs)
    assert rows_of(ag.funding_by_year(pm)) == [
        ("quantum", 2019, 4e6, 1), ("quantum", 2020, 2.5e6, 1), ("quantum", 2021, 3.5e6, 1), ("quantum", 2022, 7e6, 1)]
    assert rows_of(ag.funding_by_programme(pm)) == [("quantum", "H2020", 1e7, 3), ("quantum", "HORIZON", 7e6, 1)]
    assert rows_of(ag.funding_totals(ag.funding_by_year(pm))) == [("quantum", 1.7e7, 4, 4250000.0)]
    assert rows_of(ag.projects_by_country(po)) == [("quantum", "CH", 1), ("quantum", "DE", 3), ("quantum", "FR", 3), ("quantum", "NL", 1)]
    assert rows_of(pr.pairs_countries(po)) == [("quantum", "CH", "DE", 1), ("quantum", "DE", "FR", 2), ("quantum", "FR", "NL", 1)]
    assert rows_of(ag.cross_border_share(pm, po)) == [("quantum", 4, 0, 0.0)]
    assert rows_of(ag.cross_border_share(pm, po, 2)) == [("quantum", 4, 4, 1.0)]
    assert [r[3] for r in rows_of(pr.pairs_orgs(po))] == [1] * 6
    assert ag.last_full_year(projects.where("title like 'quantum%'"), "start_date").first()[0] == 2021
    rate = se.series_cagr(ag.funding_by_year(pm), "funding", F.lit(2021)).first()
    assert (rate["cagr"], rate["period"]) == (-6.46, "2019-2021")
    flags = {r["name"]: r for r in ag.orgs_with_flags(po).collect()}
    assert flags["KPN NV"]["is_sme"] and not flags["CNRS"]["is_coordinator"]


CODES = {1: ("G06N H01L", 2020), 2: ("G06N H01L", 2020), 3: ("G06N G01N", 2021), 4: ("G06N H04L", 2021),
         5: ("H04L G06N", 2022), 6: ("G01N G06N B01D", 2022)}


@pytest.fixture(scope="module")
def links(spark):
    data = [("q", r, c, y) for r, (cs, y) in CODES.items() for c in cs.split()]
    return spark.createDataFrame(data, "tech string, record_id long, code string, pub_year int")


def test_code_jaccard(links):
    assert {r["code"]: r["n"] for r in co.top_codes(links).collect()} == {"G06N": 6, "G01N": 2, "H01L": 2, "H04L": 2, "B01D": 1}
    got = {(r["code_a"], r["code_b"]): r["jaccard"] for r in co.code_jaccard(links).collect()}
    assert got == {("G06N", "H01L"): 0.3333, ("G01N", "G06N"): 0.3333, ("G06N", "H04L"): 0.3333, ("B01D", "G01N"): 0.5, ("B01D", "G06N"): 0.1667}
    assert co.connections(co.code_jaccard(links)).first()["pairs"] == 5


def test_window_equals_direct(links):
    cube = pr.pairs_codes_year(links), co.codes_by_year(links)
    for a, b in ((2020, 2020), (2020, 2021), (2021, 2022), (2020, 2022)):
        direct = co.code_jaccard(links.where(F.col("pub_year").between(a, b)))
        assert rows_of(co.code_jaccard_window(*cube, a, b)) == rows_of(direct)


def test_matrix_is_symmetric(links):
    labels = ["B01D", "G01N", "G06N", "H01L", "H04L"]
    m = {(r["code_a"], r["code_b"]): r["jaccard"] for r in co.code_jaccard_matrix(co.code_jaccard(links)).collect()}
    assert set(m) == {(a, b) for a in labels for b in labels}
    assert all(m[a, b] == m[b, a] for a in labels for b in labels) and all(m[a, a] == 0 for a in labels)


def test_single_code_records_have_no_links(patents):
    assert rows_of(no.code_links(patents)) == [(2, "G06N", 2020), (2, "H01L", 2020)]


def test_describe_code(spark):
    dim = spark.createDataFrame([("G", "physics"), ("G06", "computing"), ("G06N", "models")], "code string, description string")
    codes = spark.createDataFrame([("G06N10/00",), ("G06F",), ("G99",), ("H01",), (" G06",)], "code string")
    got = {r["code"]: r["description"] for r in co.describe_code(codes, dim).collect()}
    assert got == {"G06N10/00": "models", "G06F": "computing", "G99": "physics", "H01": "", " G06": "computing"}


def test_merge_actors_and_shares(spark):
    a = spark.createDataFrame([("q", "Siemens", 10), ("q", "SAP", 1)], "tech string, actor string, n long")
    o = spark.createDataFrame(
        [("q", "SIEMENS ", "DE", 3, False, True), ("q", "CNRS", "FR", 5, False, False)],
        "tech string, name string, country string, n long, is_sme boolean, is_coordinator boolean",
    )
    merged = ac.merge_actors(a, o)
    ranked = ac.rank_share(merged).orderBy("rank").collect()
    assert ac.rank_share(merged, None).orderBy("rank").collect() == ranked
    assert (ranked[0]["name"], ranked[0]["total"], ranked[0]["country"]) == ("SIEMENS", 13, "DE")
    total = 13 + 5 + 1
    assert ac.hhi(merged).first()["hhi"] == round((13**2 + 5**2 + 1) / total**2 * 10000, 1)
    assert ac.hhi(merged).first()["concentration"] == "High"


def test_actor_dynamics_with_year_gap(spark):
    rows = [("q", a, y, 1) for y, names in {2018: "AX", 2020: "ABC", 2021: "CD"}.items() for a in names]
    got = {r["year"]: r for r in ac.actor_dynamics(spark.createDataFrame(rows, "tech string, actor string, year int, n long")).collect()}
    assert (got[2018]["new_entrant_rate"], got[2018]["persistence_rate"]) == (1.0, 0.0)
    assert (got[2020]["new_entrant_rate"], got[2020]["persistence_rate"]) == (0.6667, 0.5)
    assert (got[2021]["new_entrant_rate"], got[2021]["persistence_rate"]) == (0.5, 0.3333)


def test_entities_expire(spark):
    actors = spark.createDataFrame([("q", "A", None), ("q", "B", None), ("q", "C", "FR")], "tech string, name string, country string")
    ref = spark.createDataFrame(
        [("a", "L1", "A AG", "DE", "2024-03-01"), ("a", "L0", "OLD", "XX", "2024-01-01"), ("B", "L2", "B", "DE", "2023-01-01"),
         ("c", None, None, None, "2024-03-01")],
        "raw_name string, lei string, legal_name string, country string, resolved_at string",
    ).withColumn("resolved_at", F.col("resolved_at").cast("date"))
    got = {r["name"]: (r["lei"], r["country"]) for r in ac.resolve_entities(actors, ref, F.lit("2024-03-10").cast("date")).collect()}
    assert got == {"A": ("L1", "DE"), "B": (None, None), "C": (None, "FR")}


def test_h_index(spark):
    for cites in ([], [0, 0], [10, 8, 5, 4, 3], [25, 8, 5, 3, 3], [1] * 5, [None, 7]):
        clean = sorted((c or 0 for c in cites), reverse=True)
        want = sum(c >= i for i, c in enumerate(clean, 1))
        df = spark.createDataFrame([("q", c) for c in cites], "tech string, citations long")
        got = ag.h_index(df).first()
        assert (got["h_index"] if got else 0) == want


def test_pairs_from_code_text(quantum):
    two = co.code_jaccard_of(quantum)
    assert rows_of(two) == rows_of(co.code_jaccard(co.code_links_of(quantum)))
    assert rows_of(two) == [("quantum", "G06N", "H01L", 1, 1, 1.0)]


def test_entities_refreshed(spark):
    """New and expired names are asked, negative answers hold until they expire, other rows stay."""
    schema = "raw_name string, lei string, legal_name string, country string, resolved_at date"
    day = lambda text: F.lit(text).cast("date")
    rows = [("Acme ", "L1", "Acme", "DE", "2024-03-01"), ("OLD", "L2", "Old", "FR", "2023-01-01"), ("NOBODY", None, None, None, "2024-03-01"), ("REST", "L9", "Rest", "US", "2020-01-01")]
    reference = spark.createDataFrame(rows, schema.replace("date", "string")).withColumn("resolved_at", F.col("resolved_at").cast("date"))
    actors = spark.createDataFrame([("acme",), ("old",), ("Old ",), ("nobody",), ("new",), ("unknown",), ("",), (None,)], "name string")
    registry = spark.createDataFrame(
        [("New", "L3", "New Ltd", "GB"), ("NEW", "L4", "New AG", "CH"), ("old", "L5", "Old SA", "FR"), ("acme", "L7", "x", "x")],
        "raw_name string, lei string, legal_name string, country string",
    )
    asked = ac.names_to_ask(actors, reference, day("2024-03-10"))
    assert rows_of(asked) == [("NEW",), ("OLD",), ("UNKNOWN",)]
    after = ac.refresh_entities(asked, registry, reference, day("2024-03-10"))
    assert {r["raw_name"]: r["lei"] for r in after.collect()} == {
        "ACME": "L1", "OLD": "L5", "NOBODY": None, "REST": "L9", "NEW": "L4", "UNKNOWN": None,
    }
    assert after.schema["resolved_at"] == reference.schema["resolved_at"]
    assert ac.names_to_ask(actors, after, day("2024-03-11")).count() == 0
    assert rows_of(ac.names_to_ask(actors, after, day("2024-06-05"))) == [("ACME",), ("NOBODY",)]
    empty = ac.names_to_ask(actors, reference.limit(0), day("2024-03-10"))
    assert empty.count() == 5 and ac.refresh_entities(empty, registry.limit(0), reference.limit(0), day("2024-03-10")).count() == 5
