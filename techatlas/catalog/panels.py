"""Registered panels: one row per technology, lists written as text so that SQL can match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from techatlas.catalog.oracle import BASE, CROSS, FEATURES, HHI, ORACLE, SUMMARY, TOP3, fit_ctes, top
from techatlas.catalog.queries import QUERIES, Ctx, query
from techatlas.plans import panels as pa
from techatlas.plans import reports as rp
from techatlas.plans.analysis import Analysis
from techatlas.sources import ingest as ig

AS_OF = "2001-08-01"


def _piece(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType):
        return value.cast("decimal(18,4)").cast("string")
    if isinstance(kind, T.ArrayType):
        return F.array_join(value.cast("array<string>"), " ")
    return value.cast("string")


def flat(panel: DataFrame) -> DataFrame:
    """Each list of rows as ``a:b:c|a:b:c``."""

    def column(f: T.StructField) -> Column:
        kind = f.dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
            return F.col(f.name)
        inner = kind.elementType.fields
        return F.array_join(
            F.transform(f.name, lambda x: F.concat_ws(":", *[_piece(x[g.name], g.dataType) for g in inner])), "|"
        ).alias(f.name)

    return panel.select(*[column(f) for f in panel.schema.fields])


def _panels(c: Ctx) -> Analysis:
    return Analysis(c.tables, c.terms(), clamp=True, materialized=True)


@query
def panel_landscape(c):
    return flat(pa.landscape(_panels(c)))


@query
def panel_maturity(c):
    return flat(pa.maturity(_panels(c)))


@query
def panel_competitive(c):
    return flat(pa.competitive(_panels(c), F.lit(AS_OF).cast("date")))


@query
def panel_funding(c):
    return flat(pa.funding(_panels(c)))


@query
def panel_code_flow(c):
    return flat(pa.code_flow(_panels(c), c.star.code_dimension()))


@query
def panel_geographic(c):
    return flat(pa.geographic(_panels(c)))


@query
def panel_research_impact(c):
    return flat(pa.research_impact(_panels(c)))


@query
def panel_temporal(c):
    return flat(pa.temporal(_panels(c)))


@query
def panel_report_text(c):
    """(tech, panel, text) of all panels."""
    return rp.report_texts(_panels(c), c.star.code_dimension(), F.lit(AS_OF).cast("date"))


@query
def radar_all(c):
    """Run metadata and every panel's text per technology."""
    full = rp.all_panels(_panels(c), c.star.code_dimension(), F.lit(AS_OF).cast("date"))
    names = [n for n, f in zip(full.columns, full.schema.fields) if isinstance(f.dataType, T.StructType)]
    return full.select(
        "tech",
        "complete_until",
        *[F.array_join(x, "|").alias(x) for x in ("sources", "methods", "warnings")],
        *[F.col(f"{n}.analysis_text").alias(f"{n}_text") for n in names],
    )


@query
def radar_with_failed_panel(c):
    """All panels while one fails as it runs: seven are whole, and a warning names the eighth."""
    broken = c.star.code_dimension().withColumn("description", F.raise_error(F.lit("no descriptions")).cast("string"))
    full = rp.all_panels(_panels(c), broken, F.lit(AS_OF).cast("date"))
    return full.select(
        "tech",
        "complete_until",
        F.array_join("sources", "|").alias("sources"),
        F.array_join("warnings", "|").alias("warnings"),
        "landscape.total_records",
        "landscape.total_projects",
        "maturity.phase",
        "competitive.hhi",
        "funding.total_funding",
        "geographic.total_countries",
        "research_impact.h_index",
        "temporal.dominant_programme",
        F.col("code_flow").isNull().alias("code_flow_missing"),
    )


@query
def run_metadata(c):
    meta = pa.run_metadata(_panels(c))
    return meta.select("tech", "complete_until", *[F.array_join(x, "|").alias(x) for x in ("sources", "methods", "warnings")])


def _export(name: str, build) -> None:
    """Register the export table of a panel as ``export_<panel>``."""

    def run(c):
        dimension = c.star.country_dimension() if name == "geographic" else None
        return ig.export_rows(build(c), name, dimension)

    run.__name__ = f"export_{name}"
    run.__doc__ = f"Rows of the {name} export."
    query(run)


_export("landscape", lambda c: pa.landscape(_panels(c)))
_export("maturity", lambda c: pa.maturity(_panels(c)))
_export("competitive", lambda c: pa.competitive(_panels(c), F.lit(AS_OF).cast("date")))
_export("funding", lambda c: pa.funding(_panels(c)))
_export("code_flow", lambda c: pa.code_flow(_panels(c), c.star.code_dimension()))
_export("geographic", lambda c: pa.geographic(_panels(c)))
_export("research_impact", lambda c: pa.research_impact(_panels(c)))
_export("temporal", lambda c: pa.temporal(_panels(c)))


# --- SQL twins -----------------------------------------------------------------------

#: BASE with the records cut at their last full year, as the panels do.
CLAMPED = BASE.replace(
    "where (t.start_year is null or r.pub_year >= t.start_year)",
    """where r.pub_year <= (select case when substr(d,6,2)::int >= 11 then substr(d,1,4)::int else substr(d,1,4)::int - 1 end
    from (select max(pub_date) d from records)) and (t.start_year is null or r.pub_year >= t.start_year)""",
)
assert CLAMPED != BASE


def rows(source: str, order: str, *fields: str) -> str:
    return f"(select tech, string_agg(concat_ws(':', {', '.join(fields)}), '|' order by {order}) s from {source} group by 1)"


def dec(x: str) -> str:
    return f"{x}::decimal(18,4)"


def panel_sql(scalars: str, *parts: tuple[str, str]) -> str:
    """Scalars and lists on the technologies asked for; parts are (columns, source)."""
    joins = " ".join(f"left join {src} p{i} on p{i}.tech = t.tech" for i, (_, src) in enumerate(parts))
    cols = ", ".join(c.replace("@", f"p{i}.") for i, (c, _) in enumerate(parts))
    return f"select t.tech, {scalars}{cols} from terms t {joins}"


GROWN = "(select *, " + ", ".join(
    f"round(({v} - lag({v}) over w) / nullif(lag({v}) over w, 0) * 100, 1) {v[0:2]}g" for v in ("records", "projects", "publications")
) + " from ms window w as (partition by tech order by year))"

ORACLE["panel_landscape"] = CLAMPED + panel_sql(
    "",
    ("@a total_records, @b total_projects, @c total_publications",
     "(select tech, sum(records)::bigint a, sum(projects)::bigint b, sum(publications)::bigint c from ms group by 1)"),
    ("@s time_series", rows(GROWN, "year", "year", "records", "projects", "publications", dec("reg"), dec("prg"), dec("pug"))),
    ("@c total_countries", "(select tech, count(*) c from mc group by 1)"),
    ("@s top_countries", rows(f"(select * from mc {top(20, 'total', 'country')})", "total desc, country", "country", "records", "projects", "total")),
)

ORACLE["panel_maturity"] = (
    BASE.rstrip() + ",\n" + fit_ctes() + ",\n"
    + FEATURES + ",\n" + f"""hp as ({ORACLE['maturity_phase_heuristic'].split(FEATURES)[1].strip()}),
cg as ({ORACLE['cagr_records'].removeprefix(BASE)}),
fv as (select c.tech, c.year, c.n, c.cumulative, case when f.tech is not null then round(b.rs * case when b.model = 'Logistic'
  then 1.0 / (1.0 + exp(-b.rk_ * (c.year - b.rx))) else exp(-exp(-b.rk_ * (c.year - b.rx))) end, 1) end fitted
  from cum c left join fitp f on f.tech = c.tech and f.year = c.year left join best b on b.tech = c.tech)
"""
    + panel_sql(
        "",
        ("""case when b.model is null then null when b.maturity_percent < 10 then 'Emerging' when b.maturity_percent < 50 then 'Growing' when b.maturity_percent < 90 then 'Mature' else 'Saturation' end phase,
  h.phase heuristic_phase, h.confidence heuristic_confidence, case when b.model is not null then round(least(0.95, greatest(0.1, b.r2 * 0.6::double + least(1.0, b.np / 15.0) * 0.2::double + least(1.0, b.ly / 200.0) * 0.2::double)), 2) end confidence,
  coalesce(g.cagr, 0) cagr, coalesce(b.maturity_percent, 0) maturity_percent, coalesce(b.sat, 0) saturation_level, coalesce(b.x0, 0) inflection_year,
  coalesce(b.r2, 0) r_squared, coalesce(b.model, '') fit_model, @s time_series""",
         rows("fv", "year", "year", "n", "cumulative", dec("fitted"))),
    )
    + " left join best b on b.tech = t.tech left join hp h on h.tech = t.tech left join cg g on g.tech = t.tech"
)

RK = "(select *, row_number() over (partition by tech order by total desc, name) as rank, round(total / sum(total) over (partition by tech), 4) share from ma)"
LEI = """(select upper(trim(raw_name)) as name, lei, legal_name, country lc from lei where resolved_at <= date '2001-08-01' and resolved_at >= date '2001-08-01' - 90
  qualify row_number() over (partition by upper(trim(raw_name)) order by resolved_at desc, coalesce(lei, '') desc) = 1)"""
NODES = ORACLE["collab_network_nodes"].removeprefix(BASE)
ORACLE["panel_competitive"] = CLAMPED + panel_sql(
    "",
    ("@hhi, case when @hhi < 1500 then 'Low' when @hhi < 2500 then 'Moderate' when @hhi is not null then 'High' end concentration", HHI),
    ("@c total_actors", "(select tech, count(*) c from ma group by 1)"),
    ("@top3_share", TOP3),
    ("@s top_actors", rows(f"(select * from {RK} where rank <= 20)", "rank", "name", "total", dec("share"))),
    ("@s full_actors", rows(f"(select r.*, e.lei, e.legal_name, coalesce(r.country, e.lc) cc from {RK} r left join {LEI} e on r.name = e.name where rank <= 100)",
                            "rank", "rank", "name", "records", "projects", "total", dec("share"), "cc", "is_sme", "is_coordinator", "lei", "legal_name")),
    ("@s network_nodes", rows(f"({NODES})", "n desc, name", "name", "n", "type")),
    ("@s network_edges", rows("edges", "weight desc, source, target", "source", "target", "weight")),
)

ORACLE["panel_funding"] = CLAMPED + panel_sql(
    "",
    ("@total_funding, @projects total_projects, @avg_project_size", f"({ORACLE['funding_totals'].removeprefix(BASE)})"),
    ("@cagr, @period", f"({ORACLE['cagr_funding'].removeprefix(BASE)})"),
    ("@s by_programme", rows("fp", "funding desc, programme", "programme", dec("funding"), "n")),
    ("@s time_series", rows("fy", "year", "year", dec("funding"), "n")),
    ("@s by_year_programme", rows("fyp", "year, programme", "year", "programme", dec("funding"), "n")),
    ("@s instruments", rows("fi", "year, scheme", "scheme", "year", "n", dec("funding"))),
    ("@s top_instruments", rows(f"({ORACLE['top_instruments'].removeprefix(BASE)})", "n desc, scheme", "scheme", "n")),
)

DESC = f"({ORACLE['describe_code'].removeprefix(BASE)})"
ORACLE["panel_code_flow"] = CLAMPED + panel_sql(
    "",
    ("@records", "(select tech, count(distinct record_id) records from cl group by 1)"),
    ("@pairs pairs_count, @visible_pairs", f"({ORACLE['connections'].removeprefix(BASE)})"),
    ("@max_jaccard, @mean_jaccard", SUMMARY),
    ("@s labels", rows("tc", "n desc, code", "code", "n")),
    ("@s pairs", rows(f"(select j.*, a.description da, b.description db from jac j join {DESC} a on a.code = code_a join {DESC} b on b.code = code_b)",
                      "jaccard desc, code_a, code_b", "code_a", "da", "code_b", "db", dec("jaccard"))),
    ("@s code_years", rows("(select cy.* from cy where (tech, code) in (select tech, code from tc))", "code, pub_year", "code", "pub_year", "n")),
    ("@s pair_years", rows("""(select x.tech, x.pub_year, x.code a, y.code b, count(distinct x.record_id) n
      from (select * from cl semi join tc using (tech, code)) x join (select * from cl semi join tc using (tech, code)) y
        on x.tech = y.tech and x.record_id = y.record_id and x.code < y.code group by all)""",
      "pub_year, a, b", "pub_year", "a", "b", "n")),
)

AC = f"({ORACLE['records_by_actor_country'].removeprefix(BASE)})"
CITIES = "(select tech, city, country, count(distinct project_id) n from po group by 1, 2, 3)"
CITY = f"({ORACLE['orgs_by_city'].removeprefix(BASE)})"
ALL_AC = AC.replace(top(30, "n", "country"), "")
GEO = f"""(select tech, country, sum(r)::bigint records, sum(p)::bigint projects, sum(r + p)::bigint total from (
  select tech, country, n r, 0 p from {ALL_AC} union all select tech, country, n, 0 from rbc where tech not in (select tech from {ALL_AC})
  union all select tech, country, 0, n from pbc) group by 1, 2)"""
ORACLE["panel_geographic"] = CLAMPED + panel_sql(
    "",
    ("@c total_countries", f"(select tech, count(*) c from {GEO} group by 1)"),
    ("@c total_cities", f"(select tech, count(*) c from {CITIES} group by 1)"),
    ("@cross_border_share", CROSS),
    ("@s country_distribution", rows(GEO, "total desc, country", "country", "records", "projects", "total")),
    ("@s city_distribution", rows(CITY, "n desc, city, country", "city", "country", "n")),
    ("@s collaboration_pairs", rows(f"({ORACLE['pairs_countries'].removeprefix(BASE)})", "n desc, a, b", "a", "b", "n")),
)

ORACLE["panel_research_impact"] = CLAMPED + panel_sql(
    "",
    ("@h_index", f"({ORACLE['h_index'].removeprefix(BASE)})"),
    ("@papers, @citations, @avg_citations, @influential_ratio", f"({ORACLE['impact_totals'].removeprefix(BASE)})"),
    ("@s citation_trend", rows(f"({ORACLE['citation_trend'].removeprefix(BASE)})", "year", "year", "citations", "papers")),
    ("@s top_papers", rows(f"({ORACLE['top_papers'].removeprefix(BASE)})", "position", "title", "venue", "year", "citations", "authors_short")),
    ("@s top_venues", rows(f"({ORACLE['venue_distribution'].removeprefix(BASE)})", "n desc, venue", "venue", "n", dec("share"))),
    ("@s publication_types", rows(f"({ORACLE['publication_types'].removeprefix(BASE)})", "n desc, type", "type", "n")),
)

YRS = "yrs as (select tech, year, count(*) total_actors, lag(year) over (partition by tech order by year) p from ay group by 1, 2)"
DYN = f"({ORACLE['actor_dynamics'].split(YRS)[1].strip()})"
ORACLE["panel_temporal"] = CLAMPED.rstrip() + ",\n" + YRS + "\n" + panel_sql(
    "",
    ("@a new_entrant_rate, @b persistence_rate", f"(select tech, arg_max(new_entrant_rate, year) a, arg_max(persistence_rate, year) b from {DYN} group by 1)"),
    ("@scheme dominant_programme", f"({ORACLE['dominant_programme'].removeprefix(BASE)})"),
    ("@s entrant_persistence_trend", rows(DYN, "year", "year", dec("new_entrant_rate"), dec("persistence_rate"), "total_actors")),
    ("@s actor_timeline", rows(f"({ORACLE['actor_timeline'].removeprefix(BASE)})", "total desc, actor", "actor", "total", "years_active")),
    ("@s technology_breadth", rows("tb", "year", "year", "sections", "subclasses")),
    ("@s programme_evolution", rows("fi", "year, scheme", "year", "scheme", "n")),
)

ORACLE["run_metadata"] = CLAMPED + """select t.tech, least(end_year, y) complete_until,
  (select coalesce(string_agg(s, '|' order by s), '') from (select 'records' s where t.tech in (select tech from rm) union all select 'projects' where t.tech in (select tech from pm)
    union all select 'publications' where t.tech in (select tech from pubs) union all select 'papers' where t.tech in (select tech from pap))) sources,
  'phrase search|yearly aggregation|concentration index|growth curve fit|Jaccard index|h-index' methods,
  case when y < end_year then 'record data is complete up to ' || y || ' only' else '' end warnings from terms t, lfy"""

ORACLE["export_landscape"] = CLAMPED + f"""select tech, year, records, projects, publications, reg records_growth, prg projects_growth, pug publications_growth
  from {GROWN}"""
ORACLE["export_maturity"] = BASE.rstrip() + ",\n" + fit_ctes() + "\n" + f"select tech, year, n records, cumulative, fitted from ({ORACLE['join_fitted_values'].split(fit_ctes())[1].strip()})"
ORACLE["export_competitive"] = CLAMPED + f"""select r.tech, r.rank, r.name, records, projects, total, share, coalesce(r.country, e.lc) country
  from {RK} r left join {LEI} e on r.name = e.name where rank <= 100"""
ORACLE["export_funding"] = CLAMPED + "select tech, year, n projects, funding from fy"
ORACLE["export_code_flow"] = CLAMPED + f"""select tech, code_a, a.description description_a, code_b, b.description description_b, jaccard
  from jac join {DESC} a on a.code = code_a join {DESC} b on b.code = code_b"""
ORACLE["export_geographic"] = CLAMPED + f"""select tech, g.country, coalesce(label, g.country) as label, coalesce(is_european, false) is_european, records, projects, total
  from {GEO} g left join dim_country d on d.country = g.country"""
ORACLE["export_research_impact"] = CLAMPED + f"select tech, title, year, citations, venue from ({ORACLE['top_papers'].removeprefix(BASE)})"
ORACLE["export_temporal"] = CLAMPED.rstrip() + ",\n" + YRS + f"""
select tech, year, total_actors, round(new_entrant_rate * 100, 1) new_entrant_rate, round(persistence_rate * 100, 1) persistence_rate from {DYN}"""

ORACLE["radar_with_failed_panel"] = "select m.tech, m.complete_until, m.sources, concat_ws('|', nullif(m.warnings, ''), 'code_flow: failed (SparkRuntimeException)') warnings" + """,
  l.total_records, l.total_projects, p.phase, c.hhi, f.total_funding, g.total_countries, r.h_index, t.dominant_programme, true code_flow_missing from """ + " join ".join(
    f"({ORACLE[name]}) {alias}" + (" using (tech)" if k else "")
    for k, (alias, name) in enumerate(
        {"m": "run_metadata", "l": "panel_landscape", "p": "panel_maturity", "c": "panel_competitive", "f": "panel_funding",
         "g": "panel_geographic", "r": "panel_research_impact", "t": "panel_temporal"}.items()
    )
)
