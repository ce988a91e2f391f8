"""Registered queries: every operator over the whole test tables, one per name."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from techatlas.functions import labels as lb
from techatlas.functions import names as nm
from techatlas.functions import text as tx
from techatlas.operators import actors as ac
from techatlas.operators import aggregate as ag
from techatlas.operators import codes as co
from techatlas.operators import growth as gr
from techatlas.operators import match as ma
from techatlas.operators import normalize as no
from techatlas.operators import pairs as pr
from techatlas.operators import ranking as rk
from techatlas.operators import sampling as sa
from techatlas.operators import series as se
from techatlas.operators import terms as te
from techatlas.plans import cube
from techatlas.plans.analysis import Analysis
from techatlas.session import materialize, shared_dir
from techatlas.sources.tables import StarSchema, terms_table

QUERIES: dict = {}

PREFIXES = [("hot a", "hot a", 1995, 2001), ("larg", "larg", 1995, 2001), ("cold bolt", "cold bolt", 1996, None)]
ALL_TERMS = [("anvil hot", "anvil hot", None, None), ("ring blue", "ring blue", None, None)]
KEYWORDS = [("brand 12", "Bránd 12", 1995, 2001), ("brand 3", "Brand 3", None, None), ("brand 55", "bra\u0301nd#55", 1996, None)]
TYPED = [("hot", "hot", None, None), ("blue r", "blue r", None, None), ("ol", "old", None, None)]


class Ctx:
    """Test tables and search results of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.star = StarSchema(spark, sf_dir)

    def terms(self, rows=None) -> DataFrame:
        return terms_table(self.spark, rows)

    @cached_property
    def tables(self):
        return self.star.tables()

    @cached_property
    def an(self) -> Analysis:
        return Analysis(self.tables, self.terms())

    @cached_property
    def hits(self) -> Analysis:
        """For results that use the same search hits more than once."""
        return Analysis(self.tables, self.terms(), materialized=True)

    # shared intermediate results
    @cached_property
    def merged_actors(self) -> DataFrame:
        return ac.merge_actors(ag.top_actors(self.an.record_actors, None), ag.orgs_with_flags(self.an.project_orgs, None))

    @cached_property
    def merged_countries(self) -> DataFrame:
        an = self.an
        return ac.merge_countries(ag.records_by_country(an.records, None), ag.projects_by_country(an.project_orgs, None))

    @cached_property
    def merged_series(self) -> DataFrame:
        an = self.an
        return se.merge_series(
            an.terms, ag.records_by_year(an.records), ag.projects_by_year(an.projects), an.publications_by_year
        )

    @cached_property
    def family_series(self) -> DataFrame:
        return se.spine_left_join(self.an.terms, ag.families_by_year(self.an.records))

    @cached_property
    def cumulative(self) -> DataFrame:
        return se.cumulative(self.family_series)

    @cached_property
    def fit_series(self) -> DataFrame:
        """Cumulative families up to the last full year."""
        return self.cumulative.where(F.col("year") <= self.an.last_full_record_year.scalar())

    @cached_property
    def actor_years(self) -> DataFrame:
        years = ac.actor_years(ag.actors_by_year(self.an.record_actors), ag.orgs_by_year(self.an.project_orgs, None))
        return materialize(years, "actor-years")

    @cached_property
    def kept_actors(self) -> DataFrame:
        return materialize(self.merged_actors, "actors")

    @cached_property
    def jaccard(self) -> DataFrame:
        top = materialize(co.top_codes(self.hits.code_links), "top-codes")
        return co.jaccard(pr.pairs_codes_of(self.hits.records, top), top)


def query(fn):
    """Register ``fn(ctx)`` under its name."""
    name = fn.__name__.lstrip("_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Ctx(spark, sf_dir))

    run.__name__ = name
    run.__doc__ = fn.__doc__
    QUERIES[name] = run
    return fn


# --- normalisation and whole tables --------------------------------------------------


@query
def sanitize_entities(c):
    return c.star.raw("pages").select("page_id", F.md5(nm.sanitize_entities("html")).alias("clean_md5"))


@query
def framework_from_filename(c):
    name = F.concat(
        F.when(F.col("o_orderpriority") == "1-URGENT", "cordis-FP7projects")
        .when(F.col("o_orderpriority") == "2-HIGH", "H2020_")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "cordis-Horizon-europe")
        .otherwise("misc"),
        F.col("o_orderkey").cast("string"),
        F.lit(".zip"),
    )
    return c.star.raw("orders").select("o_orderkey", nm.framework_from_filename(name).alias("framework"))


@query
def safe_float(c):
    raw = F.when(F.col("p_size") < 10, F.col("p_brand")).when(
        F.col("p_size") < 45, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))
    )
    return c.star.raw("part").select("p_partkey", nm.safe_float(raw).alias("value"))


def _lines(c):
    return c.star.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


@query
def dedupe_first_wins(c):
    return no.dedupe_first_wins(_lines(c), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query
def upsert_last_wins(c):
    return no.upsert_last_wins(_lines(c), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query
def normalize_actors_table(c):
    return no.actor_links(c.star.records()).select("record_id", "raw_name", "name")


@query
def normalize_codes_table(c):
    return no.code_links(c.star.records())


@query
def normalized_table_stats(c):
    return ag.link_stats(no.code_links(c.star.records()))


@query
def link_coverage_audit(c):
    return ag.records_without_link(c.star.records(), c.star.record_actor())


@query
def term_subset_export(c):
    matched = ma.match_all_terms(c.star.records(), c.terms(ALL_TERMS), ["title", "codes"], "record_id")
    records, links = no.term_subset(c.star.records(), c.star.record_actor(), matched)
    return records.join(links, "record_id").select("record_id", "title", "actor_id", "raw_name")


@query
def bulk_counts(c):
    s = c.star
    return ag.bulk_counts(
        records=s.records(), projects=s.projects(), organizations=s.organizations(), publications=s.publications()
    )


# --- search --------------------------------------------------------------------------


@query
def match_phrase(c):
    return c.an.records.select("tech", "record_id")


@query
def match_prefix(c):
    return ma.match_prefix(
        c.star.records(), c.terms(PREFIXES), ["title"], ["record_id", "title", "pub_year"], "pub_year"
    ).select("tech", "record_id", "title")


@query
def match_all_terms(c):
    return ma.match_all_terms(c.star.records(), c.terms(ALL_TERMS), ["title", "codes"], "record_id")


@query
def search_records(c):
    return c.an.records.select(
        "tech", "record_id", "publication_number", "country", "title", "pub_date", "applicant_names",
        "applicant_countries", "codes", "family_id",
    )


@query
def search_projects(c):
    return c.an.projects.select(
        "tech", "project_id", "framework", "acronym", "title", "objective", "keywords", "start_date", "status", "total_cost",
        "ec_max_contribution", "funding_scheme",
    )


@query
def search_project_keywords(c):
    """Projects that hold a phrase among their keywords only."""
    found = Analysis(c.tables, c.terms(KEYWORDS))
    return found.projects.select("tech", "project_id", "keywords")


@query
def records_codes(c):
    return co.records_codes(c.an.records)


@query
def records_codes_years(c):
    return co.records_codes_years(c.an.records)


@query
def table_filter_sort(c):
    return rk.filter_sort(
        c.merged_actors.select("tech", "name", "country", "total"), "000000001", ["name", "country"],
        [F.desc("total"), F.asc("name")],
    )


# --- joins ---------------------------------------------------------------------------


@query
def join_match_records(c):
    ids = c.an.records.select("tech", "record_id")
    return ids.join(c.star.records(), "record_id").select("tech", "record_id", "country", "pub_year", "title")


@query
def join_projects_orgs(c):
    return c.an.project_orgs.select("tech", "project_id", "name", "country", "city", "role", "sme")


@query
def join_record_actor(c):
    return c.an.record_actors.select("tech", "record_id", "pub_year", "actor_id", "raw_name", "actor")


@query
def pairs_actors(c):
    return pr.pairs_actors(c.an.record_actors)


@query
def pairs_orgs(c):
    return pr.pairs_orgs(c.an.project_orgs)


@query
def pairs_countries(c):
    return pr.pairs_countries(c.an.project_orgs)


@query
def pairs_codes(c):
    return pr.pairs_codes_of(c.hits.records, co.top_codes(c.hits.code_links))


@query
def pairs_codes_year(c):
    return pr.pairs_codes_year_of(c.an.records)


@query
def merge_series_full_outer(c):
    return c.merged_series


@query
def merge_countries_full_outer(c):
    return c.merged_countries


@query
def merge_actors_full_outer(c):
    return c.merged_actors.select("tech", "name", "records", "projects", "total", "is_sme", "is_coordinator")


@query
def spine_left_join(c):
    return c.family_series


@query
def refresh_entities(c):
    """The legal-entity table after two refreshes: new, expired and negative names are asked, the others are not.

    First the applicants of the records are looked up, 60 days later those and the participants of the projects; the
    registry knows three of four suppliers.
    """
    registry = c.star.raw("supplier").where("s_suppkey % 4 <> 0").select(
        F.col("s_name").alias("raw_name"),
        F.concat(F.lit("NEW"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("lei"),
        F.concat("s_name", F.lit(" Holding")).alias("legal_name"),
        F.lit(None).cast("string").alias("country"),
    )
    reference = c.star.lei_reference().where("raw_name not like '%5'")
    applicants = c.tables.record_actor.select(F.col("raw_name").alias("name"))
    participants = c.tables.organizations.select("name")
    for day, actors in (("2001-08-01", applicants), ("2001-09-30", applicants.unionAll(participants))):
        as_of = F.lit(day).cast("date")
        asked = ac.names_to_ask(actors, reference, as_of)
        reference = materialize(ac.refresh_entities(asked, registry, reference, as_of), "entities")
    return reference


@query
def resolve_entities(c):
    as_of = F.lit("2001-08-01").cast("date")
    return ac.resolve_entities(c.merged_actors, c.star.lei_reference(), as_of).select(
        "tech", "name", "total", "country", "lei", "legal_name"
    )


@query
def describe_code(c):
    return co.describe_code(c.star.record_code().select("code").distinct(), c.star.code_dimension())


@query
def country_labels(c):
    dim = c.star.country_dimension()
    return (
        c.merged_countries.join(dim, "country", "left")
        .where(~F.coalesce(F.col("is_office"), F.lit(False)))
        .select("tech", "country", "label", "is_european", "total")
    )


# --- aggregations --------------------------------------------------------------------


@query
def records_by_year(c):
    return ag.records_by_year(c.an.records)


@query
def projects_by_year(c):
    return ag.projects_by_year(c.an.projects)


@query
def families_by_year(c):
    return ag.families_by_year(c.an.records)


@query
def records_by_country(c):
    return ag.records_by_country(c.an.records)


@query
def projects_by_country(c):
    return ag.projects_by_country(c.an.project_orgs)


@query
def records_by_actor_country(c):
    return ag.records_by_actor_country(c.an.records)


@query
def top_actors(c):
    return ag.top_actors(c.an.record_actors)


@query
def top_actor_strings(c):
    return ag.top_actor_strings(c.an.records)


@query
def actors_by_year(c):
    return ag.actors_by_year(c.an.record_actors, 200)


@query
def actor_code_strings(c):
    return ag.actor_code_strings(c.an.records)


@query
def top_orgs(c):
    return ag.top_orgs(c.an.project_orgs)


@query
def orgs_with_flags(c):
    return ag.orgs_with_flags(c.an.project_orgs)


@query
def orgs_by_city(c):
    return ag.orgs_by_city(c.an.project_orgs)


@query
def orgs_by_year(c):
    return ag.orgs_by_year(c.an.project_orgs)


@query
def orgs_by_programme(c):
    return ag.orgs_by_programme(c.an.project_orgs)


@query
def funding_by_year(c):
    return ag.funding_by_year(c.an.projects)


@query
def funding_by_programme(c):
    return ag.funding_by_programme(c.an.projects)


@query
def funding_by_year_programme(c):
    return ag.funding_by_year_programme(c.an.projects)


@query
def funding_by_instrument(c):
    return ag.funding_by_instrument(c.an.projects)


@query
def cross_border_share(c):
    return ag.cross_border_share(c.hits.projects, c.hits.project_orgs)


@query
def last_full_year(c):
    return c.an.last_full_record_year


@query
def effective_end_year(c):
    return ag.effective_end_year(c.an.terms, c.an.last_full_record_year)


@query
def top_codes(c):
    return co.top_codes(c.an.code_links)


@query
def code_ranking(c):
    return co.code_ranking(c.an.code_links)


@query
def codes_by_year(c):
    return co.codes_by_year(c.an.code_links)


@query
def citation_trend(c):
    return ag.citation_trend(c.an.papers)


@query
def venue_distribution(c):
    return ag.venue_distribution(c.an.papers)


@query
def publication_types(c):
    return ag.publication_types(c.an.papers)


@query
def impact_totals(c):
    return ag.impact_totals(c.an.papers)


@query
def programme_evolution(c):
    return ag.programme_evolution(ag.funding_by_instrument(c.an.projects))


@query
def programme_pivot_funding(c):
    return ag.programme_pivot_funding(ag.funding_by_year_programme(c.an.projects))


@query
def programme_shares(c):
    return ag.programme_shares(ag.funding_by_programme(c.an.projects))


@query
def top_instruments(c):
    return ag.top_instruments(ag.funding_by_instrument(c.an.projects), 3)


@query
def dominant_programme(c):
    return ag.dominant_programme(ag.funding_by_instrument(c.an.projects))


@query
def technology_breadth(c):
    return co.technology_breadth(c.an.records)


@query
def funding_totals(c):
    return ag.funding_totals(ag.funding_by_year(c.an.projects))


# --- series and windows --------------------------------------------------------------


@query
def yoy_growth(c):
    return se.yoy_growth(c.merged_series, ["records", "projects", "publications"])


@query
def cumulative_series(c):
    return c.cumulative


@query
def cagr_records(c):
    return se.series_cagr(c.family_series, "n", c.an.last_full_record_year.scalar())


@query
def cagr_funding(c):
    return se.series_cagr(ag.funding_by_year(c.an.projects), "funding", c.an.last_full_project_year.scalar())


@query
def actor_rank_share(c):
    return ac.rank_share(c.kept_actors).select("tech", "rank", "name", "records", "projects", "total", "share")


@query
def top_share(c):
    return ac.top_share(ac.rank_share(c.kept_actors, 20), c.kept_actors)


@query
def actor_dynamics(c):
    return ac.actor_dynamics(c.actor_years)


@query
def actor_timeline(c):
    t = ac.actor_timeline(c.actor_years)
    return t.select("tech", "actor", "total", F.concat_ws(" ", F.col("years_active").cast("array<string>")).alias("years_active"))


@query
def h_index(c):
    return ag.h_index(c.an.papers)


@query
def recent_trend_features(c):
    f = se.trend_features(c.family_series)
    return f.select(
        "tech", "years", "total", *[F.round(x, 6).alias(x) for x in ("avg_first", "avg_second", "recent_growth", "overall_growth", "variation")]
    )


@query
def best_surface_form(c):
    typed = c.terms(TYPED)
    return te.best_surface_form(te.term_counts(_titles(c, typed), typed))


@query
def jaccard_top_pairs(c):
    return co.jaccard_top_pairs(c.jaccard).select("tech", "code_a", "code_b", "jaccard")


@query
def jaccard_summary(c):
    return co.jaccard_summary(c.jaccard)


# --- order, top-k, sets --------------------------------------------------------------


@query
def topk(c):
    return rk.top_k(co.code_ranking(c.an.code_links), 30, "n", ["code"], "rank")


@query
def europe_first_order(c):
    return rk.europe_first(c.merged_countries, c.star.country_dimension())


@query
def top_papers(c):
    return rk.top_papers(c.an.papers)


@query
def union_years(c):
    an = c.an
    return se.union_years(an.terms, ag.records_by_year(an.records), ag.projects_by_year(an.projects))


@query
def entrants_except(c):
    return ac.entrants_except(c.actor_years)


@query
def persisting_intersect(c):
    return ac.persisting_intersect(c.actor_years)


@query
def union_term_matches(c):
    return c.an.records.select("record_id").distinct()


@query
def jaccard_set_union(c):
    return c.jaccard.select("tech", "code_a", "code_b", "union_n")


@query
def dedupe_ordered(c):
    seen = c.an.records.select("tech", "country", "record_id")
    return te.dedupe_ordered(seen, "country", "record_id")


# --- scalar functions ----------------------------------------------------------------


@query
def normalize_actor_name(c):
    raw = F.concat(
        F.lit("  "),
        F.col("c_name"),
        F.when(F.col("c_nationkey") < 5, " Co. Ltd.")
        .when(F.col("c_nationkey") < 10, "  & Co. KG")
        .when(F.col("c_nationkey") < 15, " Corporation")
        .when(F.col("c_nationkey") < 20, ", Inc.")
        .otherwise(" Holding AG Ltd "),
    )
    return c.star.raw("customer").select("c_custkey", nm.normalize_actor_name(raw).alias("name"))


@query
def normalize_code(c):
    raw = F.explode(tx.split_list("codes"))
    return (
        c.star.order_text()
        .select("l_orderkey", raw.alias("code"))
        .select("l_orderkey", "code", nm.normalize_code("code", 4).alias("code4"), nm.normalize_code("code", 3).alias("code3"))
    )


@query
def code_sets(c):
    return (
        c.star.order_text()
        .select("l_orderkey", nm.code_set("codes").alias("s"))
        .where(F.size("s") >= 2)
        .select("l_orderkey", F.array_join("s", " ").alias("code_set"))
    )


@query
def parse_pub_date(c):
    raw = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyyMM")).otherwise(
        F.date_format("o_orderdate", "yyyyMMdd")
    )
    return c.star.raw("orders").select("o_orderkey", nm.parse_pub_date(raw).alias("pub_date"))


@query
def section_bucket(c):
    return c.star.record_code().groupBy(lb.section_bucket("code").alias("section")).agg(F.count("*").alias("n"))


@query
def title_case_smart(c):
    raw = F.when(F.col("p_size") < 20, F.upper("p_name")).when(F.col("p_size") < 35, F.initcap("p_name")).otherwise(F.col("p_name"))
    return c.star.raw("part").select("p_partkey", lb.title_case_smart(raw).alias("term"))


@query
def title_case(c):
    raw = F.concat_ws("-", "p_type", "p_name")
    return c.star.raw("part").select("p_partkey", lb.title_case(raw).alias("term"))


@query
def format_int_de(c):
    return c.star.raw("documents").select("doc_id", lb.format_int_de(F.col("n_chars") * 1234567).alias("text"))


@query
def format_pct_de(c):
    return c.star.raw("lineitem").groupBy("l_orderkey").agg(
        lb.format_pct_de(F.sum(F.col("l_discount").cast("decimal(10,2)")).cast("double") / F.count("*") * 100).alias("text")
    )


@query
def format_eur(c):
    scale = F.when(F.col("o_orderstatus") == "P", 100000.0).when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.01)
    return c.star.raw("orders").select("o_orderkey", lb.format_eur(F.col("o_totalprice") * scale).alias("text"))


@query
def trend_word(c):
    r = se.series_cagr(ag.funding_by_year(c.an.projects), "funding")
    return r.select("tech", lb.trend_word("cagr").alias("trend"))


@query
def hhi_band(c):
    return ac.hhi(c.merged_actors).select("tech", "concentration")


@query
def r2_band(c):
    v = F.col("l_discount") * 10
    return c.star.raw("lineitem").select(lb.r2_band(v).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query
def top3_band(c):
    return ac.top_share(ac.rank_share(c.kept_actors, 20), c.kept_actors).select("tech", lb.top3_band("top3_share").alias("band"))


@query
def connectivity_band(c):
    return co.jaccard_summary(c.jaccard).select("tech", lb.connectivity_band("mean_jaccard").alias("band"))


@query
def breadth_trend(c):
    b = co.technology_breadth(c.an.records)
    ends = b.groupBy("tech").agg(F.min_by("subclasses", "year").alias("a"), F.max_by("subclasses", "year").alias("z"))
    return ends.select("tech", lb.breadth_trend("a", "z").alias("trend"))


@query
def eu_share_top10(c):
    top = rk.top_k(c.merged_countries, 10, "total", ["country"])
    dim = c.star.country_dimension()
    return top.join(dim, "country", "left").groupBy("tech").agg(
        F.count_if("is_european").alias("european"), F.count("*").alias("listed")
    )


# --- domain analytics ----------------------------------------------------------------


@query
def hhi(c):
    return ac.hhi(c.merged_actors)


@query
def code_jaccard(c):
    return c.jaccard


@query
def code_jaccard_by_year(c):
    pair_year = pr.pairs_codes_year_of(c.hits.records)
    years = co.codes_by_year(c.hits.code_links)
    a = years.select("tech", "pub_year", F.col("code").alias("a"), F.col("n").alias("n_a"))
    b = years.select("tech", "pub_year", F.col("code").alias("b"), F.col("n").alias("n_b"))
    return pair_year.join(a, ["tech", "pub_year", "a"]).join(b, ["tech", "pub_year", "b"])


@query
def code_jaccard_window(c):
    pairs, years = pr.pairs_codes_year_of(c.hits.records), co.codes_by_year(c.hits.code_links)
    return co.code_jaccard_window(pairs, years, 1997, 1999, 10)


def _cube(c) -> str:
    """The year cube of the hits, written as a table."""
    out = shared_dir(c.spark, "cube")
    cube.write(c.hits, out)
    return out


@query
def code_cube_pairs(c):
    """Yearly pair counts of all codes, as the stored cube holds them."""
    return cube.pairs(c.spark, _cube(c))


@query
def code_cube_window(c):
    """A span of years answered from the stored cube."""
    return cube.window(c.spark, _cube(c), 1997, 1999, 10)


@query
def code_cube_maps(c):
    """The yearly counts of the top codes as a client gets them: nested maps, here as rows."""
    maps = cube.year_maps(c.spark, _cube(c), co.top_codes(c.hits.code_links))
    years = maps.select("tech", F.explode("pair_counts").alias("year", "counts"))
    return years.select("tech", "year", F.explode("counts").alias("pair", "n"))


@query
def code_jaccard_matrix(c):
    """Sections as labels: the matrix of first characters."""
    links = co.code_links_of(c.hits.records, level=1)
    return co.code_jaccard_matrix(co.code_jaccard(links))


@query
def connections(c):
    return co.connections(c.jaccard)


def _sample_rows(c):
    """Dated hits; sampling passes over them several times, so they are written first."""
    return materialize(c.an.records.select("tech", F.col("pub_year").alias("year"), "record_id"), "hits")


@query
def stratified_sample(c):
    return sa.stratified_sample(_sample_rows(c), "record_id", 500)


@query
def strata_report(c):
    return sa.strata_report(_sample_rows(c), 500)


@query
def jaccard_confidence(c):
    links = materialize(co.code_links_of(c.an.records), "links")
    rows = links.select("tech", F.col("pub_year").alias("year"), "record_id").distinct()
    sampled = sa.stratified_sample(rows, "record_id", 200)
    sample_links = links.join(sampled.select("tech", "record_id"), ["tech", "record_id"], "left_semi")
    sizes = rows.groupBy("tech").agg(F.count("*").alias("population"))
    sample_sizes = sampled.groupBy("tech").agg(F.count("*").alias("sample_size"))
    est = co.code_jaccard(sample_links).join(sizes, "tech").join(sample_sizes, "tech")
    ci = co.jaccard_confidence(F.col("n"), F.col("union_n"), F.col("sample_size"), F.col("population"))
    return est.select("tech", "code_a", "code_b", ci.alias("ci")).select("tech", "code_a", "code_b", "ci.*")


@query
def growth_curve_fit(c):
    return gr.growth_curve_fit(c.fit_series).drop("fitted_values")


@query
def growth_model_select(c):
    return gr.growth_model_select(gr.growth_curve_fit(c.fit_series)).drop("fitted_values")


@query
def join_fitted_values(c):
    series = materialize(c.cumulative, "series")
    complete = series.where(F.col("year") <= c.an.last_full_record_year.scalar())
    return gr.join_fitted_values(series, gr.growth_model_select(gr.growth_curve_fit(complete)))


@query
def maturity_phase(c):
    best = gr.growth_model_select(gr.growth_curve_fit(c.fit_series))
    return best.select(
        "tech",
        se.maturity_phase(F.col("maturity_percent")).alias("phase"),
        se.phase_confidence(F.col("r2")).alias("confidence"),
    )


@query
def maturity_phase_heuristic(c):
    return se.heuristic_phase(se.trend_features(c.family_series))


@query
def fit_confidence(c):
    series = materialize(c.fit_series, "series")
    totals = series.groupBy("tech").agg(F.count("*").alias("years"), F.max("cumulative").alias("total"))
    best = gr.growth_model_select(gr.growth_curve_fit(series))
    return best.join(totals, "tech").select(
        "tech", se.fit_confidence(F.col("r2"), F.col("years"), F.col("total")).alias("confidence")
    )


def _network(c):
    an = c.hits
    actors = an.keep(
        ac.merge_actors(ag.top_actors(an.record_actors, None), ag.orgs_with_flags(an.project_orgs, None)), "actors"
    )
    return actors, ac.collab_edges(an.record_actors, an.project_orgs, actors)


@query
def collab_network(c):
    return _network(c)[1]


@query
def collab_network_nodes(c):
    actors, edges = _network(c)
    return ac.collab_nodes(edges, actors)


def _titles(c, typed):
    """Titles of both sources whose words start with the typed text."""
    records = ma.match_prefix(c.star.records(), typed, ["title"], ["record_id", "title"])
    projects = ma.match_prefix(c.star.projects(), typed, ["title"], ["project_id", "title"])
    return records.select("tech", "title").unionAll(projects.select("tech", "title"))


@query
def suggest_terms(c):
    typed = c.terms(TYPED)
    return te.suggest_terms(_titles(c, typed), typed)


@query
def publications_by_year(c):
    return c.an.publications_by_year


@query
def papers_top_n(c):
    found = rk.top_k(c.an.papers, 200, "citations", ["paper_id"])
    return found.select("tech", "paper_id", "title", "venue", "year", "citations")


@query
def source_failure_scan(c):
    status = F.when(F.col("event_type") == "error", "Query 'publication_years' failed: ").when(
        F.col("event_type") == "click", "legal entity resolution failed: "
    ).otherwise("ok ")
    log = c.star.raw("events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("tech"),
        F.concat(status, "props").alias("warning"),
    )
    patterns = c.spark.createDataFrame(te.FAILURE_PATTERNS, "pattern string, source string")
    return te.source_failures(log, patterns)
