"""Short texts about each panel, and all panels of a batch together."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from techatlas.functions import labels as lb
from techatlas.plans import panels as pa
from techatlas.plans.analysis import Analysis
from techatlas.plans.apart import run_apart
from techatlas.session import materialize


def _say(template: str, *args: Column) -> Column:
    """The sentence, or null (and hence no sentence) if any part is missing."""
    parts = template.split("{}")
    pieces: list[Column] = []
    for i, text in enumerate(parts):
        if text:
            pieces.append(F.lit(text))
        if i < len(args):
            pieces.append(args[i].cast("string"))
    return F.concat(*pieces)


def _text(condition: Column, *sentences: Column) -> Column:
    return F.when(condition, F.concat_ws(" ", *sentences)).otherwise("").alias("analysis_text")


def _first(column: str, field: str) -> Column:
    return F.try_element_at(F.col(column), F.lit(1))[field]


def _last(column: str, field: str) -> Column:
    return F.try_element_at(F.col(column), F.lit(-1))[field]


def _pct(c: Column, decimals: int = 1) -> Column:
    return lb.format_pct_de(c, decimals)


def _int(c: Column) -> Column:
    return lb.format_int_de(c)


def landscape_text() -> Column:
    r, p, u = (F.coalesce(f"total_{x}", F.lit(0)) for x in ("records", "projects", "publications"))
    total = r + p + u
    best = F.greatest(r, p, u)
    source = F.when(r == best, "patents").when(p == best, "projects").otherwise("publications")
    rg, pg = _last("time_series", "records_growth"), _last("time_series", "projects_growth")
    return _text(
        total > 0,
        _say("{} activities were found ({} patents, {} projects, {} publications).", _int(total), _int(r), _int(p), _int(u)),
        _say("Most of them are {} with a share of {}.", source, _pct(best / F.nullif(total, F.lit(0)) * 100)),
        _say("The leading country is {} with {} activities.", _first("top_countries", "country"), _int(_first("top_countries", "total"))),
        F.when(rg != 0, _say("Patents changed by {} in the last year covered.", _pct(rg))),
        F.when(pg != 0, _say("Projects changed by {} in the last year covered.", _pct(pg))),
        F.when(F.size("top_countries") > 0, _say("{} countries are active.", _int(F.col("total_countries")))),
    )


def maturity_text() -> Column:
    m, conf = F.col("maturity_percent"), F.col("confidence")
    years = F.size("time_series")
    total = F.aggregate("time_series", F.lit(0).cast("long"), lambda s, x: s + x["records"])
    return _text(
        F.col("phase").isNotNull() | F.col("heuristic_phase").isNotNull(),
        _say("The technology is in the phase {} at {} of its saturation level.", F.col("phase"), _pct(m)),
        F.when(F.col("phase").isNull(), _say("Its recent trend puts the technology in the phase {}.", F.col("heuristic_phase"))),
        F.when(
            F.col("r_squared") > 0,
            _say("The {} growth curve fits with {} quality (R2 = {}).", F.col("fit_model"), lb.r2_band("r_squared"),
                 F.round("r_squared", 3).cast("decimal(5,3)")),
        ),
        F.when(F.col("cagr") != 0, _say("The annual growth rate is {}: {}.", _pct(F.col("cagr")), lb.trend_word("cagr"))),
        F.when(F.col("inflection_year") > 0, _say("The turning point lies in {}.", F.round("inflection_year", 0).cast("int"))),
        F.when(conf > 0, _say("Confidence is {}, from {} years and {} patent families.", _pct(conf * 100, 0), years, _int(total))),
        F.when(m >= 90, "Saturation is reached.").when(m > 0, _say("{} remain up to saturation (90%).", _pct(90 - m))),
    )


def competitive_text() -> Column:
    top3 = F.col("top3_share")
    return _text(
        F.size("top_actors") > 0,
        F.when(F.col("hhi") > 0, _say("The concentration index is {} ({}).", _int(F.floor("hhi")), F.lower("concentration"))),
        _say("The leading actor is {} with a share of {}.", _first("top_actors", "name"), _pct(_first("top_actors", "share") * 100)),
        F.when(top3 > 0, _say("The top three hold {}: a {} field.", _pct(top3 * 100), lb.top3_band("top3_share"))),
        _say("{} actors were found.", _int(F.col("total_actors"))),
        F.when(
            F.size("network_edges") > 0,
            _say("The network has {} nodes and {} edges.", _int(F.size("network_nodes")), _int(F.size("network_edges"))),
        ),
    )


def funding_text() -> Column:
    names = F.array_join(F.transform("top_instruments", lambda x: F.concat(x["scheme"], F.lit(" ("), _int(x["n"]), F.lit(")"))), ", ")
    return _text(
        F.col("total_funding") > 0,
        _say("Total funding is {}.", lb.format_eur("total_funding")),
        F.when(F.col("total_projects") > 0, _say("{} projects get {} on average.", _int(F.col("total_projects")), lb.format_eur("avg_project_size"))),
        F.when(F.col("cagr") != 0, _say("Funding changes by {} a year ({}): {}.", _pct(F.col("cagr")), F.col("period"), lb.trend_word("cagr"))),
        _say("The largest programme is {} with {}.", _first("by_programme", "programme"), lb.format_eur(_first("by_programme", "funding"))),
        F.when(F.size("top_instruments") > 0, _say("The most frequent instruments are {}.", names)),
    )


def code_flow_text() -> Column:
    def dec(c: str) -> Column:
        return F.round(c, 3).cast("decimal(5,3)")

    return _text(
        F.size("labels") >= 2,
        _say("{} patents link codes in {} pairs.", _int(F.col("records")), _int(F.coalesce("pairs_count", F.lit(0)))),
        _say("{} codes were compared.", _int(F.size("labels"))),
        F.when(
            F.col("max_jaccard") > 0,
            _say("The strongest link joins {} and {} (Jaccard = {}).", _first("pairs", "code_a"), _first("pairs", "code_b"), dec("max_jaccard")),
        ),
        F.when(F.col("mean_jaccard") > 0, _say("The mean Jaccard index is {}: {} interconnection.", dec("mean_jaccard"), lb.connectivity_band("mean_jaccard"))),
    )


def geographic_text(european: list[str] = lb.EU_EEA) -> Column:
    top10 = F.slice("country_distribution", 1, 10)
    eu = F.size(F.filter(top10, lambda x: F.upper(x["country"]).isin(european)))
    others = F.size(top10) - eu
    return _text(
        F.col("total_countries") > 0,
        _say("The technology is present in {} countries and {} cities.", _int(F.col("total_countries")), _int(F.coalesce("total_cities", F.lit(0)))),
        F.when(F.col("cross_border_share") > 0, _say("{} of the projects cross borders.", _pct(F.col("cross_border_share") * 100))),
        _say("The leading country is {} with {} activities.", _first("country_distribution", "country"), _int(_first("country_distribution", "total"))),
        _say("The strongest axis runs between {} and {} ({} projects).", _first("collaboration_pairs", "a"), _first("collaboration_pairs", "b"),
             _int(_first("collaboration_pairs", "n"))),
        F.when(eu > others, _say("{} of the top {} are European.", eu, F.size(top10))).when(
            eu > 0, _say("The top ten hold {} European and {} other countries.", eu, others)),
    )


def impact_text() -> Column:
    return _text(
        F.col("papers") > 0,
        _say("The h-index of the field is {}.", F.col("h_index")),
        _say("{} papers are cited {} times on average.", _int(F.col("papers")), F.col("avg_citations").cast("decimal(18,1)")),
        F.when(F.col("influential_ratio") > 0, _say("{} of the citations are influential.", _pct(F.col("influential_ratio") * 100))),
        _say('The most cited paper is "{}" with {} citations.', _first("top_papers", "title"), _int(_first("top_papers", "citations"))),
        _say('The leading venue is "{}" with {} papers.', _first("top_venues", "venue"), _int(_first("top_venues", "n"))),
    )


def temporal_text() -> Column:
    a, z = _first("technology_breadth", "subclasses"), _last("technology_breadth", "subclasses")
    trend = F.when(F.size("technology_breadth") >= 2, lb.breadth_trend(a, z))
    return _text(
        F.size("entrant_persistence_trend") > 0,
        _say("{} of the actors are new.", _pct(F.col("new_entrant_rate") * 100)),
        _say("{} of the previous actors stayed.", _pct(F.col("persistence_rate") * 100)),
        _say("The main instrument is {}.", F.col("dominant_programme")),
        _say("The most active actor is {} with {} activities.", _first("actor_timeline", "actor"), _int(_first("actor_timeline", "total"))),
        _say("The field became {} ({} to {} subclasses).", trend, a, z),
    )


def panel_builders(
    an: Analysis, code_dimension: DataFrame, as_of: Column | None = None
) -> dict[str, Callable[[], DataFrame]]:
    """For each panel a function that gives its table with the text."""
    return {
        "landscape": lambda: pa.landscape(an).withColumn("analysis_text", landscape_text()),
        "maturity": lambda: pa.maturity(an).withColumn("analysis_text", maturity_text()),
        "competitive": lambda: pa.competitive(an, as_of).withColumn("analysis_text", competitive_text()),
        "funding": lambda: pa.funding(an).withColumn("analysis_text", funding_text()),
        "code_flow": lambda: pa.code_flow(an, code_dimension).withColumn("analysis_text", code_flow_text()),
        "geographic": lambda: pa.geographic(an).withColumn("analysis_text", geographic_text()),
        "research_impact": lambda: pa.research_impact(an).withColumn("analysis_text", impact_text()),
        "temporal": lambda: pa.temporal(an).withColumn("analysis_text", temporal_text()),
    }


def report_texts(an: Analysis, code_dimension: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(tech, panel, analysis_text) of all panels, which are computed side by side; an error of one is raised."""

    def text(name: str, build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: an.keep(build().select("tech", F.lit(name).alias("panel"), "analysis_text"), "texts")

    builders = panel_builders(an, code_dimension, as_of)
    done = run_apart(an.terms.sparkSession, {name: text(name, build) for name, build in builders.items()})
    for outcome in done.values():
        if outcome.error:
            raise outcome.error
    return reduce(DataFrame.unionAll, [outcome.value for outcome in done.values()])


def all_panels(
    an: Analysis, code_dimension: DataFrame, as_of: Column | None = None, time_limit: float | None = None
) -> DataFrame:
    """One row per technology: run metadata and every panel as a struct.

    The panels are computed side by side and written. One that fails or takes over ``time_limit`` seconds is null in
    every row, and a warning says so; the others are whole.
    """
    spark = an.terms.sparkSession
    builders = {"metadata": lambda: pa.run_metadata(an), **panel_builders(an, code_dimension, as_of)}

    def written(name: str, build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        # one row per technology: written, so that the joins below stay a small plan
        return lambda: materialize(build(), f"panel-{name}")

    done = run_apart(spark, {name: written(name, build) for name, build in builders.items()}, time_limit)
    out = done.pop("metadata")
    warnings = [o.warning for o in (out, *done.values()) if o.warning]
    rows = out.value if out.warning is None else pa.no_metadata(an.terms)
    rows = rows.withColumn("warnings", F.concat("warnings", F.array(*map(F.lit, warnings)).cast("array<string>")))
    for name, outcome in done.items():
        if outcome.warning:
            rows = rows.withColumn(name, F.lit(None).cast("struct<analysis_text:string>"))
        else:
            rest = [c for c in outcome.value.columns if c != "tech"]
            rows = rows.join(outcome.value.select("tech", F.struct(*rest).alias(name)), "tech", "left")
    return rows


def write_panels(
    spark: SparkSession,
    an: Analysis,
    code_dimension: DataFrame,
    out: str,
    as_of: Column | None = None,
    time_limit: float | None = None,
) -> DataFrame:
    """Write every panel to its own folder, side by side; one that fails or takes too long does not stop the others.

    ``an`` should be materialized, so the corpora are searched once, not once per panel.
    Returns (panel, status, message).
    """

    def writer(name: str, build: Callable[[], DataFrame]) -> Callable[[], None]:
        return lambda: build().write.mode("overwrite").parquet(f"{out}/{name}")

    work = {name: writer(name, build) for name, build in panel_builders(an, code_dimension, as_of).items()}
    done = run_apart(spark, work, time_limit)
    status = [(name, "failed" if o.warning else "ok", o.message) for name, o in done.items()]
    return spark.createDataFrame(status, "panel string, status string, message string")
