"""Counts and sums per technology.

Inputs are match tables, ``(tech, record_id, …)`` or ``(tech, project_id, …)``, as
``operators.match`` returns them. Distinct counts are planned by Spark in two steps
(distinct on the id first), so one frequent key does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techatlas.functions.names import normalize_actor_name
from techatlas.functions.text import blank_to_null, split_list
from techatlas.operators.ranking import top_k


def cents(c: Column | str) -> Column:
    """Amounts with two decimals; their sum does not depend on the order of summation."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,2)")


def money(c: Column | str) -> Column:
    return F.sum(cents(c)).cast("double")


def _distinct(df: DataFrame, keys: list, row_id: str) -> DataFrame:
    return df.groupBy("tech", *keys).agg(F.countDistinct(row_id).alias("n"))


# --- records -------------------------------------------------------------------------


def records_by_year(matches: DataFrame) -> DataFrame:
    return (
        matches.where("pub_year is not null")
        .groupBy("tech", F.col("pub_year").alias("year"))
        .agg(F.count("*").alias("n"))
    )


def families_by_year(matches: DataFrame) -> DataFrame:
    """Distinct families per year; plain record counts for technologies without any family."""
    yearly = (
        matches.where("pub_year is not null")
        .groupBy("tech", F.col("pub_year").alias("year"))
        .agg(F.countDistinct("family_id").alias("families"), F.count("*").alias("records"))
    )
    # one row per technology and year here, so the window is small
    most = F.max("families").over(Window.partitionBy("tech"))
    n = F.when(most > 0, F.col("families")).otherwise(F.col("records"))
    return yearly.select("tech", "year", n.alias("n")).where("n > 0")


def records_by_country(matches: DataFrame, limit: int | None = 20) -> DataFrame:
    return top_k(matches.groupBy("tech", "country").agg(F.count("*").alias("n")), limit, "n", ["country"])


def records_by_actor_country(
    matches: DataFrame, limit: int | None = 30, distinct_per_record: bool = False
) -> DataFrame:
    """Mentions of two-letter applicant countries (or distinct records mentioning them)."""
    codes = F.transform(split_list("applicant_countries"), lambda c: F.upper(c))
    if distinct_per_record:
        codes = F.array_distinct(codes)
    counted = (
        matches.select("tech", F.explode(codes).alias("country"))
        .where(F.length("country") == 2)
        .groupBy("tech", "country")
        .agg(F.count("*").alias("n"))
    )
    return top_k(counted, limit, "n", ["country"])


def record_actors(matches: DataFrame, record_actor: DataFrame, normalized: bool = True) -> DataFrame:
    """Matches joined with their actors; ``actor`` is the normalised name."""
    name = normalize_actor_name("raw_name") if normalized else F.col("raw_name")
    return matches.join(record_actor, "record_id").withColumn("actor", name)


def top_actors(actor_matches: DataFrame, limit: int | None = 20) -> DataFrame:
    return top_k(_distinct(actor_matches, ["actor"], "record_id"), limit, "n", ["actor"])


def top_actor_strings(matches: DataFrame, limit: int | None = 20) -> DataFrame:
    counted = (
        matches.where(blank_to_null("applicant_names").isNotNull())
        .groupBy("tech", "applicant_names")
        .agg(F.count("*").alias("n"))
    )
    return top_k(counted, limit, "n", ["applicant_names"])


def actors_by_year(actor_matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct records per (actor, year), names merged ignoring case."""
    counted = _distinct(
        actor_matches.where("pub_year is not null").select(
            "tech", F.upper(F.trim("actor")).alias("actor"), F.col("pub_year").alias("year"), "record_id"
        ),
        ["actor", "year"],
        "record_id",
    )
    return top_k(counted, limit, "n", ["actor", "year"])


def actor_code_strings(matches: DataFrame) -> DataFrame:
    return (
        matches.where(blank_to_null("applicant_names").isNotNull() & blank_to_null("codes").isNotNull())
        .groupBy("tech", "applicant_names", "codes")
        .agg(F.count("*").alias("n"))
    )


def last_full_year(table: DataFrame, date: str) -> DataFrame:
    """One row: the last year with data up to November or later, else the year before."""
    newest = F.max(F.when(F.length(date) >= 7, F.col(date)))
    return (
        table.agg(newest.alias("newest"))
        .select(
            F.substring("newest", 1, 4).try_cast("int").alias("y"),
            F.substring("newest", 6, 2).try_cast("int").alias("m"),
        )
        .select(F.when(F.col("m") >= 11, F.col("y")).otherwise(F.col("y") - 1).alias("last_full_year"))
    )


def effective_end_year(terms: DataFrame, last_full: DataFrame) -> DataFrame:
    """Terms whose end year is cut to the last full year, with a warning where it was cut."""
    with_last = terms.withColumn("last_full_year", last_full.scalar())
    cut = F.col("last_full_year") < F.col("end_year")
    return with_last.select(
        "tech",
        "query",
        "start_year",
        F.least("end_year", "last_full_year").alias("end_year"),
        F.when(
            cut, F.format_string("record data is complete up to %d only", F.col("last_full_year"))
        ).alias("warning"),
    )


# --- projects and organisations ------------------------------------------------------


def projects_by_year(matches: DataFrame) -> DataFrame:
    return (
        matches.where("start_year is not null")
        .groupBy("tech", F.col("start_year").alias("year"))
        .agg(F.count("*").alias("n"))
    )


def project_orgs(matches: DataFrame, organizations: DataFrame) -> DataFrame:
    """Matches joined with their organisations; blank text counts as missing."""
    orgs = organizations.select(
        "project_id",
        *[blank_to_null(c).alias(c) for c in ("name", "country", "city")],
        "role",
        "sme",
    )
    return matches.join(orgs, "project_id")


def projects_by_country(orgs: DataFrame, limit: int | None = 20) -> DataFrame:
    return top_k(_distinct(orgs.where("country is not null"), ["country"], "project_id"), limit, "n", ["country"])


def country_sets(orgs: DataFrame) -> DataFrame:
    """(tech, project_id, countries): the distinct countries of a project, sorted; country codes are few."""
    return (
        orgs.where("country is not null")
        .groupBy("tech", "project_id")
        .agg(F.sort_array(F.collect_set("country")).alias("countries"))
    )


def projects_by_country_of(sets: DataFrame) -> DataFrame:
    """``projects_by_country`` without a limit, from ``country_sets``: nothing but the counts is shuffled."""
    return (
        sets.select("tech", F.explode("countries").alias("country"))
        .groupBy("tech", "country")
        .agg(F.count("*").alias("n"))
    )


def top_orgs(orgs: DataFrame, limit: int | None = 20) -> DataFrame:
    return top_k(_distinct(orgs.where("name is not null"), ["name"], "project_id"), limit, "n", ["name"])


def orgs_with_flags(orgs: DataFrame, limit: int | None = 50) -> DataFrame:
    """Per (organisation, country): projects, whether ever an SME, whether ever coordinator."""
    sme = F.coalesce(F.upper("sme") == "YES", F.lit(False))
    coordinator = F.coalesce(F.col("role") == "coordinator", F.lit(False))
    counted = (
        orgs.where("name is not null")
        .groupBy("tech", "name", "country")
        .agg(
            F.countDistinct("project_id").alias("n"),
            F.bool_or(sme).alias("is_sme"),
            F.bool_or(coordinator).alias("is_coordinator"),
        )
    )
    return top_k(counted, limit, "n", ["name", "country"])


def orgs_by_city(orgs: DataFrame, limit: int | None = 50) -> DataFrame:
    return top_k(
        _distinct(orgs.where("city is not null"), ["city", "country"], "project_id"), limit, "n", ["city", "country"]
    )


def orgs_by_year(orgs: DataFrame, limit: int | None = 200) -> DataFrame:
    counted = _distinct(
        orgs.where("name is not null and start_year is not null"),
        ["name", F.col("start_year").alias("year")],
        "project_id",
    )
    return top_k(counted, limit, "n", ["name", "year"])


def orgs_by_programme(orgs: DataFrame, limit: int | None = 500) -> DataFrame:
    counted = _distinct(
        orgs.where("name is not null and framework is not null"), ["name", "framework"], "project_id"
    )
    return top_k(counted, limit, "n", ["name", "framework"])


def cross_border_share(matches: DataFrame, orgs: DataFrame, min_countries: int = 3) -> DataFrame:
    """Share of projects with organisations from at least ``min_countries`` countries."""
    return cross_border_share_of(matches, country_sets(orgs), min_countries)


def cross_border_share_of(matches: DataFrame, sets: DataFrame, min_countries: int = 3) -> DataFrame:
    """``cross_border_share`` from ``country_sets``."""
    crossing = sets.groupBy("tech").agg(F.count_if(F.size("countries") >= min_countries).alias("cross_border"))
    total = matches.groupBy("tech").agg(F.countDistinct("project_id").alias("total"))
    return total.join(crossing, "tech", "left").select(
        "tech",
        "total",
        F.coalesce("cross_border", F.lit(0)).alias("cross_border"),
        F.round(F.coalesce("cross_border", F.lit(0)) / F.col("total"), 4).alias("cross_border_share"),
    )


# --- funding -------------------------------------------------------------------------


def _funding(matches: DataFrame, *keys) -> DataFrame:
    return (
        matches.where("ec_max_contribution is not null")
        .groupBy("tech", *keys)
        .agg(money("ec_max_contribution").alias("funding"), F.count("*").alias("n"))
    )


def funding_by_year(matches: DataFrame) -> DataFrame:
    return _funding(matches.where("start_year is not null"), F.col("start_year").alias("year"))


def funding_by_programme(matches: DataFrame) -> DataFrame:
    return _funding(matches, F.coalesce("framework", F.lit("UNKNOWN")).alias("programme"))


def funding_by_year_programme(matches: DataFrame) -> DataFrame:
    return _funding(
        matches.where("start_year is not null"),
        F.col("start_year").alias("year"),
        F.coalesce("framework", F.lit("UNKNOWN")).alias("programme"),
    )


def funding_by_instrument(matches: DataFrame) -> DataFrame:
    """Per (scheme, year); projects without funding count with amount zero."""
    return (
        matches.where(blank_to_null("funding_scheme").isNotNull() & F.col("start_year").isNotNull())
        .groupBy("tech", F.col("funding_scheme").alias("scheme"), F.col("start_year").alias("year"))
        .agg(
            F.count("*").alias("n"),
            money(F.coalesce("ec_max_contribution", F.lit(0.0))).alias("funding"),
        )
    )


def funding_totals(by_year: DataFrame) -> DataFrame:
    total = money("funding")
    return by_year.groupBy("tech").agg(
        total.alias("total_funding"),
        F.sum("n").alias("projects"),
        F.round(F.coalesce(F.try_divide(total, F.sum("n")), F.lit(0.0)), 2).alias("avg_project_size"),
    )


def programme_shares(by_programme: DataFrame) -> DataFrame:
    """Share of the total funding per programme in percent."""
    total = F.sum(cents("funding")).over(Window.partitionBy("tech")).cast("double")
    pct = F.coalesce(F.round(F.try_divide(F.col("funding"), F.col("total")) * 100, 1), F.lit(0.0))
    return by_programme.withColumn("total", total).select("tech", "programme", "funding", pct.alias("pct"))


def programme_pivot_funding(by_year_programme: DataFrame) -> DataFrame:
    """Funding in millions per year and programme, in long form: no programme is left out."""
    return by_year_programme.select("tech", "year", "programme", F.round(F.col("funding") / 1e6, 1).alias("funding_millions"))


def programme_evolution(by_instrument: DataFrame) -> DataFrame:
    """Projects per year and scheme, in long form: no scheme is left out."""
    return by_instrument.groupBy("tech", "year", "scheme").agg(F.sum("n").alias("n"))


def top_instruments(by_instrument: DataFrame, limit: int = 8) -> DataFrame:
    totals = by_instrument.groupBy("tech", "scheme").agg(F.sum("n").alias("n"))
    return top_k(totals, limit, "n", ["scheme"])


def dominant_programme(by_instrument: DataFrame) -> DataFrame:
    return top_instruments(by_instrument, 1)


# --- papers --------------------------------------------------------------------------


def citation_trend(papers: DataFrame) -> DataFrame:
    return (
        papers.where("year is not null")
        .groupBy("tech", "year")
        .agg(F.sum(F.coalesce("citations", F.lit(0))).alias("citations"), F.count("*").alias("papers"))
    )


def venue_distribution(papers: DataFrame, limit: int = 8) -> DataFrame:
    """Top venues; the share is over all papers with a venue."""
    counted = (
        papers.select("tech", blank_to_null("venue").alias("venue"))
        .where("venue is not null")
        .groupBy("tech", "venue")
        .agg(F.count("*").alias("n"))
    )
    totals = counted.groupBy("tech").agg(F.sum("n").alias("total"))
    return top_k(counted, limit, "n", ["venue"]).join(totals, "tech").select(
        "tech", "venue", "n", F.round(F.col("n") / F.col("total"), 4).alias("share")
    )


def publication_types(papers: DataFrame) -> DataFrame:
    return (
        papers.select("tech", F.explode("publication_types").alias("type"))
        .where("type <> ''")
        .groupBy("tech", "type")
        .agg(F.count("*").alias("n"))
    )


def impact_totals(papers: DataFrame) -> DataFrame:
    cited = F.sum(F.coalesce("citations", F.lit(0)))
    influential = F.sum(F.coalesce("influential", F.lit(0)))
    return papers.groupBy("tech").agg(
        F.count("*").alias("papers"),
        cited.alias("citations"),
        F.round(cited / F.count("*"), 1).alias("avg_citations"),
        F.round(F.coalesce(F.try_divide(influential, cited), F.lit(0.0)), 4).alias("influential_ratio"),
    )


def h_index(papers: DataFrame) -> DataFrame:
    """Largest h such that h papers have at least h citations.

    Papers are first counted per citation value; the running count from the top then passes
    over distinct values only. h is the best ``min(value, papers with at least that value)``.
    """
    per_value = papers.groupBy("tech", F.coalesce("citations", F.lit(0)).alias("c")).agg(
        F.count("*").alias("n")
    )
    above = F.sum("n").over(
        Window.partitionBy("tech").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        per_value.withColumn("above", above).groupBy("tech").agg(F.max(F.least("c", "above")).alias("h_index"))
    )


# --- whole tables --------------------------------------------------------------------


def bulk_counts(**tables: DataFrame) -> DataFrame:
    """Rows per table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def link_stats(record_code: DataFrame) -> DataFrame:
    """Rows, distinct codes and records, first and last year of the code link table."""
    per_code = record_code.groupBy("code").agg(
        F.count("*").alias("n"), F.min("pub_year").alias("first"), F.max("pub_year").alias("last")
    )
    records = record_code.agg(F.countDistinct("record_id").alias("records"))
    return per_code.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("code").alias("codes"),
        F.min("first").alias("min_year"),
        F.max("last").alias("max_year"),
    ).select("rows", "codes", records.scalar().alias("records"), "min_year", "max_year")


def records_without_link(records: DataFrame, record_actor: DataFrame) -> DataFrame:
    """How many records name applicants but have no link row."""
    return (
        records.where(blank_to_null("applicant_names").isNotNull())
        .join(record_actor, "record_id", "left_anti")
        .agg(F.count("*").alias("missing"))
    )
