"""The eight analyses, each one row per technology with nested lists.

Lists are bounded by construction: years of a window, or the top rows of a ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from techatlas.operators import actors as ac
from techatlas.operators import aggregate as ag
from techatlas.operators import codes as co
from techatlas.operators import growth as gr
from techatlas.operators import pairs as pr
from techatlas.operators import ranking as rk
from techatlas.operators import series as se
from techatlas.plans.analysis import Analysis


def nested(df: DataFrame, name: str, fields: list[str], order: list[str], desc: str | None = None) -> DataFrame:
    """(tech, name): the rows of a technology as a sorted array of structs.

    ``desc`` names a numeric column sorted descending before ``order``.
    """
    keys = ([(-F.col(desc)).alias("_k0")] if desc else []) + [F.col(o).alias(f"_k{i + 1}") for i, o in enumerate(order)]
    packed = F.sort_array(F.collect_list(F.struct(F.struct(*keys).alias("k"), F.struct(*fields).alias("v"))))
    return df.groupBy("tech").agg(F.transform(packed, lambda x: x["v"]).alias(name))


def _assemble(terms: DataFrame, *parts: DataFrame) -> DataFrame:
    """All parts on the technologies asked for; a technology without hits keeps its row."""
    out = terms.select("tech")
    for p in parts:
        out = out.join(p, "tech", "left")
    return out


def landscape(an: Analysis) -> DataFrame:
    """Activity per year and country over all sources."""
    series = an.keep(
        se.merge_series(
            an.terms, ag.records_by_year(an.records), ag.projects_by_year(an.projects), an.publications_by_year
        ),
        "series",
    )
    values = ["records", "projects", "publications"]
    grown = se.yoy_growth(series, values)
    countries = ac.merge_countries(an.filing_countries, an.project_countries)
    totals = series.groupBy("tech").agg(*[F.sum(v).alias(f"total_{v}") for v in values])
    return _assemble(
        an.terms,
        totals,
        nested(grown, "time_series", ["year", *values, *[f"{v}_growth" for v in values]], ["year"]),
        countries.groupBy("tech").agg(F.count("*").alias("total_countries")),
        nested(
            rk.top_k(countries, 20, "total", ["country"]), "top_countries", ["country", "records", "projects", "total"],
            ["country"], "total",
        ),
    )


def maturity(an: Analysis) -> DataFrame:
    """Phase of each technology from the growth curve of its patent families, and from their recent trend.

    The curve uses complete years only and is null where there are too few for any fit; the trend
    (``heuristic_…``) and the series shown are of all years.
    """
    families = an.keep(ag.families_by_year(an.all_records), "families")
    series = se.cumulative(se.spine_left_join(an.terms, families).withColumnRenamed("n", "records"), "records")
    complete = series.where(F.col("year") <= an.last_full_record_year.scalar())
    size = complete.groupBy("tech").agg(F.count("*").alias("years"), F.max("cumulative").alias("fitted_total"))
    best = an.keep(gr.growth_model_select(gr.growth_curve_fit(complete)), "fits")
    growth = se.series_cagr(complete, "records").select("tech", "cagr")
    fallback = se.heuristic_phase(se.trend_features(series, "records")).select(
        "tech", F.col("phase").alias("heuristic_phase"), F.col("confidence").alias("heuristic_confidence")
    )
    with_fit = gr.join_fitted_values(series, best)
    joined = _assemble(
        an.terms, best, growth, size, fallback,
        nested(with_fit, "time_series", ["year", "records", "cumulative", "fitted"], ["year"]),
    )
    has_fit = F.col("model").isNotNull()
    conf = se.fit_confidence(F.col("r2"), F.col("years"), F.col("fitted_total"))
    return joined.select(
        "tech",
        F.when(has_fit, se.maturity_phase(F.col("maturity_percent"))).alias("phase"),
        F.when(has_fit, conf).alias("confidence"),
        "heuristic_phase",
        "heuristic_confidence",
        F.coalesce("cagr", F.lit(0.0)).alias("cagr"),
        F.coalesce("maturity_percent", F.lit(0.0)).alias("maturity_percent"),
        F.coalesce("sat", F.lit(0.0)).alias("saturation_level"),
        F.coalesce("x0", F.lit(0.0)).alias("inflection_year"),
        F.coalesce("r2", F.lit(0.0)).alias("r_squared"),
        F.coalesce("model", F.lit("")).alias("fit_model"),
        "time_series",
    )


def competitive(an: Analysis, as_of: Column | None = None, actor_cap: int | None = 100) -> DataFrame:
    """Strongest actors of both sources, concentration, and who works with whom.

    All actors count in totals, shares and concentration; ``actor_cap`` cuts the list shown (None: all).
    """
    actors = an.keep(
        ac.merge_actors(ag.top_actors(an.record_actors, None), ag.orgs_with_flags(an.project_orgs, None)), "actors"
    )
    ranked = ac.rank_share(actors, actor_cap)
    best = ranked if actor_cap is None or actor_cap >= 20 else ac.rank_share(actors, 20)
    known = ac.resolve_entities(ranked, an.tables.lei_reference, F.current_date() if as_of is None else as_of)
    edges = an.keep(ac.collab_edges(an.record_actors, an.project_orgs, actors), "edges")
    nodes = ac.collab_nodes(edges, actors)
    full = ["rank", "name", "records", "projects", "total", "share", "country", "is_sme", "is_coordinator", "lei", "legal_name"]
    return _assemble(
        an.terms,
        ac.hhi(actors),
        actors.groupBy("tech").agg(F.count("*").alias("total_actors")),
        ac.top_share(best, actors),
        nested(best.where("rank <= 20"), "top_actors", ["name", "total", "share"], ["rank"]),
        nested(known, "full_actors", full, ["rank"]),
        nested(nodes, "network_nodes", ["name", "n", "type"], ["name"], "n"),
        nested(edges, "network_edges", ["source", "target", "weight"], ["source", "target"], "weight"),
    )


def funding(an: Analysis) -> DataFrame:
    """Funding per year, programme and instrument."""
    by_year = an.keep(ag.funding_by_year(an.projects), "funding-years")
    instruments = an.instruments
    growth = se.series_cagr(by_year, "funding", an.last_full_project_year.scalar())
    return _assemble(
        an.terms,
        ag.funding_totals(by_year),
        growth.select("tech", "cagr", "period"),
        nested(ag.funding_by_programme(an.projects), "by_programme", ["programme", "funding", "n"], ["programme"], "funding"),
        nested(by_year.withColumnRenamed("n", "projects"), "time_series", ["year", "funding", "projects"], ["year"]),
        nested(
            ag.funding_by_year_programme(an.projects), "by_year_programme", ["year", "programme", "funding", "n"],
            ["year", "programme"],
        ),
        nested(instruments, "instruments", ["scheme", "year", "n", "funding"], ["year", "scheme"]),
        nested(ag.top_instruments(instruments, 3), "top_instruments", ["scheme", "n"], ["scheme"], "n"),
    ).withColumnRenamed("projects", "total_projects")


def code_flow(an: Analysis, dimension: DataFrame, top_n: int = 15) -> DataFrame:
    """Which classification codes occur together; technologies with under two codes have none.

    ``pair_years`` and ``code_years`` hold the yearly counts of the codes listed, so that any span of years can be
    looked at; those of all codes are a table (``plans.cube``).
    """
    links = an.code_links
    code_years = an.keep(co.codes_by_year(links), "code-years")
    counts = code_years.groupBy("tech", "code").agg(F.sum("n").alias("n"))
    top = an.keep(rk.top_k(counts, top_n, "n", ["code"]), "top-codes")
    # a record has one year, so the pairs of all years are sums of the yearly ones
    yearly = an.keep(pr.pairs_codes_in(an.code_sets, top, yearly=True), "code-pair-years")
    total = yearly.groupBy("tech", "a", "b").agg(F.sum("n").alias("n"))
    pairs = an.keep(co.jaccard(total, top), "code-pairs")
    described = co.describe_code(top.select("code").distinct(), dimension)
    a = described.select(F.col("code").alias("code_a"), F.col("description").alias("description_a"))
    b = described.select(F.col("code").alias("code_b"), F.col("description").alias("description_b"))
    named = pairs.join(a, "code_a").join(b, "code_b")
    return _assemble(
        an.terms,
        co.analysed_records(an.code_sets),
        co.connections(pairs).withColumnRenamed("pairs", "pairs_count"),
        co.jaccard_summary(pairs),
        nested(top, "labels", ["code", "n"], ["code"], "n"),
        nested(named, "pairs", ["code_a", "description_a", "code_b", "description_b", "jaccard"], ["code_a", "code_b"], "jaccard"),
        nested(code_years.join(top.select("tech", "code"), ["tech", "code"], "left_semi"),
               "code_years", ["code", "pub_year", "n"], ["code", "pub_year"]),
        nested(yearly, "pair_years", ["pub_year", "a", "b", "n"], ["pub_year", "a", "b"]),
    )


def geographic(an: Analysis) -> DataFrame:
    """Countries, cities and cross-border work; applicant countries where there are any."""
    named = an.keep(ag.records_by_actor_country(an.records, None), "applicant-countries")
    filing = an.filing_countries.join(named.select("tech").distinct(), "tech", "left_anti")
    countries = ac.merge_countries(named.unionByName(filing), an.project_countries)
    cities = an.keep(ag.orgs_by_city(an.project_orgs, None), "cities")
    shown = rk.top_k(cities, 50, "n", ["city", "country"])
    pairs = pr.pairs_countries_of(an.country_sets)
    return _assemble(
        an.terms,
        countries.groupBy("tech").agg(F.count("*").alias("total_countries")),
        cities.groupBy("tech").agg(F.count("*").alias("total_cities")),
        ag.cross_border_share_of(an.projects, an.country_sets).select("tech", "cross_border_share"),
        nested(countries, "country_distribution", ["country", "records", "projects", "total"], ["country"], "total"),
        nested(shown, "city_distribution", ["city", "country", "n"], ["city", "country"], "n"),
        nested(pairs, "collaboration_pairs", ["a", "b", "n"], ["a", "b"], "n"),
    )


def research_impact(an: Analysis) -> DataFrame:
    """h-index, venues, types and best papers of all matches."""
    return _assemble(
        an.terms,
        ag.h_index(an.papers),
        ag.impact_totals(an.papers),
        nested(ag.citation_trend(an.papers).withColumnRenamed("papers", "n"), "citation_trend", ["year", "citations", "n"], ["year"]),
        nested(rk.top_papers(an.papers), "top_papers", ["title", "venue", "year", "citations", "authors_short"], ["position"]),
        nested(ag.venue_distribution(an.papers), "top_venues", ["venue", "n", "share"], ["venue"], "n"),
        nested(ag.publication_types(an.papers), "publication_types", ["type", "n"], ["type"], "n"),
    )


def temporal(an: Analysis) -> DataFrame:
    """Who enters and who stays, breadth of codes, programmes over time."""
    years = ac.actor_years(ag.actors_by_year(an.record_actors), ag.orgs_by_year(an.project_orgs, None))
    years = an.keep(years, "actor-years")
    dynamics = an.keep(ac.actor_dynamics(years), "dynamics")
    latest = dynamics.groupBy("tech").agg(
        F.max_by("new_entrant_rate", "year").alias("new_entrant_rate"),
        F.max_by("persistence_rate", "year").alias("persistence_rate"),
    )
    instruments = an.instruments
    return _assemble(
        an.terms,
        latest,
        ag.dominant_programme(instruments).select("tech", F.col("scheme").alias("dominant_programme")),
        nested(dynamics, "entrant_persistence_trend", ["year", "new_entrant_rate", "persistence_rate", "total_actors"], ["year"]),
        nested(ac.actor_timeline(years), "actor_timeline", ["actor", "total", "years_active"], ["actor"], "total"),
        nested(co.technology_breadth(an.records), "technology_breadth", ["year", "sections", "subclasses"], ["year"]),
        nested(instruments, "programme_evolution", ["year", "scheme", "n"], ["year", "scheme"]),
    )


def run_metadata(an: Analysis) -> DataFrame:
    """Sources with hits, methods and warnings per technology."""
    def seen(df: DataFrame, label: str) -> DataFrame:
        return df.select("tech").distinct().withColumn("source", F.lit(label))

    sources = (
        seen(an.records, "records")
        .unionAll(seen(an.projects, "projects"))
        .unionAll(seen(an.publications_by_year, "publications"))
        .unionAll(seen(an.papers, "papers"))
        .groupBy("tech")
        .agg(F.sort_array(F.collect_list("source")).alias("sources"))
    )
    clamped = ag.effective_end_year(an.terms, an.last_full_record_year)
    methods = ["phrase search", "yearly aggregation", "concentration index", "growth curve fit", "Jaccard index", "h-index"]
    return clamped.join(sources, "tech", "left").select(
        "tech",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.array(*[F.lit(m) for m in methods]).alias("methods"),
        F.array_compact(F.array("warning")).alias("warnings"),
        F.col("end_year").alias("complete_until"),
    )


def no_metadata(terms: DataFrame) -> DataFrame:
    """``run_metadata`` where nothing is known."""
    none = F.array().cast("array<string>")
    return terms.select(
        "tech", none.alias("sources"), none.alias("methods"), none.alias("warnings"), F.lit(None).cast("int").alias("complete_until")
    )
