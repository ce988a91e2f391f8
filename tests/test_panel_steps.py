import threading

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from techatlas.functions import names as nm
from techatlas.functions import text as tx
from techatlas.operators import aggregate as ag
from techatlas.operators import codes as co
from techatlas.operators import pairs as pr
from techatlas.plans import panels as pa
from techatlas.plans import reports as rp
from techatlas.plans.analysis import Analysis
from techatlas.sources.tables import StarSchema, terms_table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def an(spark):
    terms = terms_table(spark, [("of", "hot", 1995, 2001), ("nothing", "zzz qqq", 1995, 2001)])
    return Analysis(StarSchema(spark, SF).tables(), terms, clamp=True, materialized=True)


def test_panels_read_hits_once_and_go_on_from_counts(spark, an):
    """What a panel uses several times is written, so that no panel passes over the hits once for each of its lists."""

    def read(panel):
        return {f.split("/")[-2].rsplit("-", 1)[0] for f in panel.inputFiles()}

    assert not {"project-orgs", "records"} & read(pa.geographic(an))
    assert not {"project-orgs", "records"} & read(pa.code_flow(an, StarSchema(spark, SF).code_dimension()))
    assert not {"project-orgs", "records", "projects"} & read(pa.landscape(an))
    assert "records" not in read(pa.maturity(an))
    assert set(an.record_actors.columns) == {"tech", "record_id", "pub_year", "actor"}


def test_counts_from_sets_equal_those_from_links(spark, ask):
    rows = [("q", 1, "DE"), ("q", 1, "FR"), ("q", 1, "FR"), ("q", 1, "NL"), ("q", 2, "DE"), ("q", 2, None), ("q", 3, None)]
    orgs = spark.createDataFrame([*rows, ("r", 1, "DE"), ("r", 1, "FR"), ("r", 4, "FR"), ("r", 4, "DE")], "tech string, project_id long, country string")
    sets = ag.country_sets(orgs)
    assert rows_of(ag.projects_by_country_of(sets)) == rows_of(ag.projects_by_country(orgs, None))
    assert rows_of(pr.pairs_countries_of(sets)) == rows_of(pr.pairs_countries(orgs))
    matches = orgs.select("tech", "project_id").distinct()
    assert rows_of(ag.cross_border_share_of(matches, sets)) == [("q", 3, 1, 0.3333), ("r", 2, 0, 0.0)]
    records = spark.createDataFrame(
        [("q", 1, 2000, "A1/0, B2/0"), ("q", 1, 2000, "A1/0, B2/0"), ("q", 2, 2001, "A1/0,C3/0, B2/0"), ("q", 3, 2001, "A1/0"), ("q", 4, None, "A1/0, B2/0")],
        "tech string, record_id long, pub_year int, codes string",
    )
    sets = co.code_sets_of(records)
    top = co.top_codes(co.code_links_of(records), 2)
    for yearly in (False, True):
        assert rows_of(pr.pairs_codes_in(sets, top, yearly)) == rows_of(pr.pairs_codes_of(records, top, yearly=yearly))
    assert rows_of(co.analysed_records(sets)) == rows_of(co.analysed_records(co.links_of_sets(sets))) == [("q", 2)]


def test_legal_forms_are_cut_as_by_the_pattern(spark):
    stems = ["Foo", "Foo Bar", "", "Ünï", "Foo\n", "A  B", "&", "Foo #7", "Foo ltd gmbh"]
    ends = ["", " ", "\n", " \n", " ", "\r\n", ".", ",x", "é", "7"]
    values = [f"{s}{form}{e}" for s in stems for form in ["", *(f" {x}" for x in nm.LEGAL_FORMS), " G.m.b.H.", "GMBH", " Co., Ltd."] for e in ends]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    bare = F.translate(F.trim(F.upper("v")), ".,", "")
    want = F.trim(F.regexp_replace(F.regexp_replace(bare, nm.legal_form_pattern(), ""), r"\s+", " "))
    assert df.where(~nm.normalize_actor_name("v").eqNullSafe(want)).count() == 0
    plan = df.select(nm.normalize_actor_name("v"), tx.normalize_text("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "EndsWith" in plan.replace("endswith", "EndsWith") and "octet_length" in plan


def test_texts_are_made_side_by_side(spark, ask, monkeypatch):
    terms = ask(("q", "q", None, None))
    an = Analysis(None, terms, materialized=True)
    together = threading.Barrier(2, timeout=60)

    def build():
        together.wait()
        return terms.select("tech", F.lit("t").alias("analysis_text"))

    monkeypatch.setattr(rp, "panel_builders", lambda *a: {"one": build, "two": build})
    assert rows_of(rp.report_texts(an, None)) == [("q", "one", "t"), ("q", "two", "t")]

    def broken():
        raise KeyError("broken")

    monkeypatch.setattr(rp, "panel_builders", lambda *a: {"one": broken, "two": lambda: terms.select("tech", F.lit("t").alias("analysis_text"))})
    with pytest.raises(KeyError):
        rp.report_texts(an, None)
