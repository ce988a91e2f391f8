"""Actors of both sources: ranking, concentration, network, entity lookup, dynamics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techatlas.functions.labels import hhi_band
from techatlas.functions.names import merge_key
from techatlas.operators.pairs import set_pair_counts
from techatlas.operators.ranking import top_k


def merge_countries(records: DataFrame, projects: DataFrame, limit: int | None = None) -> DataFrame:
    """Country counts of both sources side by side; a missing side is zero."""
    stacked = records.select(
        "tech", "country", F.col("n").alias("records"), F.lit(0).cast("long").alias("projects")
    ).unionAll(projects.select("tech", "country", F.lit(0).cast("long"), "n"))
    merged = (
        stacked.groupBy("tech", "country")
        .agg(F.sum("records").alias("records"), F.sum("projects").alias("projects"))
        .withColumn("total", F.col("records") + F.col("projects"))
    )
    return top_k(merged, limit, "total", ["country"])


def merge_actors(record_actors: DataFrame, orgs: DataFrame) -> DataFrame:
    """Actors of both sources on the upper-cased name.

    ``record_actors(tech, actor, n)`` and ``orgs(tech, name, country, n, is_sme,
    is_coordinator)``; duplicates on either side add up. One shuffle for both sources.
    """
    false = F.lit(False)
    left = record_actors.select(
        "tech",
        merge_key("actor").alias("name"),
        F.col("n").alias("records"),
        F.lit(0).cast("long").alias("projects"),
        F.lit(None).cast("string").alias("country"),
        false.alias("is_sme"),
        false.alias("is_coordinator"),
    )
    right = orgs.select(
        "tech", merge_key("name").alias("name"), F.lit(0).cast("long"), "n", "country", "is_sme", "is_coordinator"
    )
    return (
        left.unionAll(right)
        .where("name <> ''")
        .groupBy("tech", "name")
        .agg(
            F.sum("records").alias("records"),
            F.sum("projects").alias("projects"),
            F.max("country").alias("country"),
            F.bool_or("is_sme").alias("is_sme"),
            F.bool_or("is_coordinator").alias("is_coordinator"),
        )
        .withColumn("total", F.col("records") + F.col("projects"))
    )


def hhi(actors: DataFrame) -> DataFrame:
    """Herfindahl-Hirschman index and its band.

    Σ(n/total)² · 10000 = Σn² / total² · 10000, so one pass of exact integer sums will do.
    """
    squares = F.sum(F.col("total").cast("decimal(19,0)") * F.col("total")).cast("double")
    total = F.sum("total").cast("double")
    index = F.round(F.coalesce(F.try_divide(squares, total * total), F.lit(0.0)) * 10000, 1)
    return actors.groupBy("tech").agg(index.alias("hhi")).withColumn("concentration", hhi_band("hhi"))


def rank_share(actors: DataFrame, limit: int | None = 100) -> DataFrame:
    """Rank by total and share of all activity, for the ``limit`` strongest actors (None: all).

    Shares are of the activity of all actors, whatever the limit.
    """
    totals = actors.groupBy("tech").agg(F.sum("total").alias("_all"))
    if limit is None:
        order = Window.partitionBy("tech").orderBy(F.desc("total"), "name")
        ranked = actors.withColumn("rank", F.row_number().over(order))
    else:
        ranked = top_k(actors, limit, "total", ["name"], "rank")
    return ranked.join(totals, "tech").withColumn(
        "share", F.round(F.col("total") / F.col("_all"), 4)
    ).drop("_all")


def top_share(ranked: DataFrame, actors: DataFrame) -> DataFrame:
    """Combined share of the three strongest actors."""
    totals = actors.groupBy("tech").agg(F.sum("total").alias("_all"))
    top3 = ranked.where("rank <= 3").groupBy("tech").agg(F.sum("total").alias("_top"))
    return top3.join(totals, "tech").select("tech", F.round(F.col("_top") / F.col("_all"), 4).alias("top3_share"))


def latest_entities(reference: DataFrame, as_of: Column, valid_days: int = 90) -> DataFrame:
    """Newest unexpired answer per name; a negative answer has no ``lei``."""
    fresh = reference.where(
        (F.col("resolved_at") <= as_of) & (F.col("resolved_at") >= F.date_sub(as_of, valid_days))
    )
    answer = F.struct("lei", "legal_name", F.col("country").alias("lei_country"))
    return fresh.groupBy(merge_key("raw_name").alias("name")).agg(
        F.max_by(answer, F.struct("resolved_at", F.coalesce("lei", F.lit("")))).alias("_e")
    ).select("name", "_e.*")


def names_to_ask(actors: DataFrame, reference: DataFrame, as_of: Column, valid_days: int = 90) -> DataFrame:
    """(name): distinct names of actors without an unexpired answer, positive or negative; null and blank ones are not asked."""
    names = actors.select(merge_key("name").alias("name")).where("name <> ''").distinct()
    return names.join(latest_entities(reference, as_of, valid_days), "name", "left_anti")


def refresh_entities(asked: DataFrame, answers: DataFrame, reference: DataFrame, as_of: Column) -> DataFrame:
    """The reference after names were asked: one row per name, the newest answer with its time.

    ``answers(raw_name, lei, legal_name, country)`` are what was found; an asked name without any becomes a negative answer,
    so it is not asked again before it expires. Answers to names that were not asked are left out. Of several answers
    to a name at one time the largest ``lei`` stays, found before not found. Older rows of other names stay as they are,
    expired or not: the next refresh asks for them when an actor bears the name.
    """
    fields = ["raw_name", "lei", "legal_name", "country", "resolved_at"]
    found = answers.select(merge_key("raw_name").alias("raw_name"), "lei", "legal_name", "country")
    new = asked.select(F.col("name").alias("raw_name")).distinct().join(found, "raw_name", "left")
    old = reference.select(merge_key("raw_name").alias("raw_name"), *fields[1:])
    both = old.unionByName(new.withColumn("resolved_at", as_of.cast(reference.schema["resolved_at"].dataType)))
    newest = F.max_by(F.struct(*fields[1:]), F.struct("resolved_at", F.coalesce("lei", F.lit(""))))
    return both.groupBy("raw_name").agg(newest.alias("_e")).select("raw_name", "_e.*")


def resolve_entities(actors: DataFrame, reference: DataFrame, as_of: Column, valid_days: int = 90) -> DataFrame:
    """Actors with their legal entity; a missing country is filled from it."""
    found = actors.join(latest_entities(reference, as_of, valid_days), "name", "left")
    return found.withColumn("country", F.coalesce("country", "lei_country")).drop("lei_country")


def collab_edges(
    record_actors: DataFrame, project_orgs: DataFrame, actors: DataFrame, max_actors: int = 40, max_edges: int | None = 100
) -> DataFrame:
    """On how many records and projects the strongest actors occur together.

    The actors are chosen first, by their uncut totals, so only their links are kept: a record
    holds at most ``max_actors`` of them, and its pairs are formed in its own row.
    """
    strong = top_k(actors, max_actors, "total", ["name"]).select("tech", "name")
    links = record_actors.select(
        "tech", F.lit("r").alias("kind"), F.col("record_id").alias("id"), merge_key("actor").alias("name")
    ).unionAll(project_orgs.select("tech", F.lit("p"), "project_id", merge_key("name")))
    sets = (
        links.join(strong, ["tech", "name"], "left_semi")
        .groupBy("tech", "kind", "id")
        .agg(F.sort_array(F.collect_set("name")).alias("names"))
    )
    edges = set_pair_counts(sets, "names", ["tech"]).select(
        "tech", F.col("a").alias("source"), F.col("b").alias("target"), F.col("n").alias("weight")
    )
    return top_k(edges, max_edges, "weight", ["source", "target"])


def collab_nodes(edges: DataFrame, actors: DataFrame) -> DataFrame:
    """Connected actors; type by the sources they appear in."""
    ends = edges.select("tech", F.explode(F.array("source", "target")).alias("name")).distinct()
    in_records, in_projects = F.col("records") > 0, F.col("projects") > 0
    return actors.join(ends, ["tech", "name"], "left_semi").select(
        "tech",
        "name",
        F.col("total").alias("n"),
        F.when(in_records & in_projects, "both").when(in_records, "patent").otherwise("cordis").alias("type"),
    )


def actor_years(record_actor_years: DataFrame, org_years: DataFrame) -> DataFrame:
    """(tech, actor, year, n) of both sources."""
    return (
        record_actor_years.select("tech", merge_key("actor").alias("actor"), "year", "n")
        .unionAll(org_years.select("tech", merge_key("name").alias("actor"), "year", "n"))
        .groupBy("tech", "actor", "year")
        .agg(F.sum("n").alias("n"))
    )


def actor_dynamics(years: DataFrame) -> DataFrame:
    """Share of new actors, and share of the previous year's actors that stay.

    "Previous" is the previous year with any actor. An actor stays if its own previous active
    year is the previous active year of the technology, so no sets are compared.
    """
    seen = years.select("tech", "actor", "year").distinct()
    by_year = Window.partitionBy("tech").orderBy("year")
    active = (
        seen.groupBy("tech", "year")
        .agg(F.count("*").alias("total_actors"))
        .select(
            "tech",
            "year",
            "total_actors",
            F.lag("year").over(by_year).alias("prev_year"),
            F.lag("total_actors").over(by_year).alias("prev_actors"),
        )
    )
    own = Window.partitionBy("tech", "actor").orderBy("year")
    stays = seen.withColumn("own_prev", F.lag("year").over(own)).join(active, ["tech", "year"])
    staying = F.count_if(F.col("own_prev") == F.col("prev_year"))
    counted = stays.groupBy("tech", "year", "total_actors", "prev_actors").agg(staying.alias("staying"))
    first = F.col("prev_actors").isNull()
    entrants = F.col("total_actors") - F.col("staying")
    return counted.select(
        "tech",
        "year",
        "total_actors",
        F.when(first, F.col("total_actors")).otherwise(entrants).alias("entrants"),
        F.when(first, F.lit(0)).otherwise(F.col("staying")).cast("long").alias("persisting"),
        F.when(first, F.lit(1.0)).otherwise(F.round(entrants / F.col("total_actors"), 4)).alias("new_entrant_rate"),
        F.when(first, F.lit(0.0)).otherwise(F.round(F.col("staying") / F.col("prev_actors"), 4)).alias("persistence_rate"),
    )


def _with_previous(years: DataFrame) -> DataFrame:
    """(tech, year, actor, own_prev, prev_year): last active year of the actor and of the technology before."""
    seen = years.select("tech", "actor", "year").distinct()
    active = seen.select("tech", "year").distinct()
    active = active.withColumn("prev_year", F.lag("year").over(Window.partitionBy("tech").orderBy("year")))
    own = F.lag("year").over(Window.partitionBy("tech", "actor").orderBy("year"))
    return seen.withColumn("own_prev", own).join(active, ["tech", "year"]).where("prev_year is not null")


def entrants_except(years: DataFrame) -> DataFrame:
    """(tech, year, actor): actors of a year that were not there in the active year before."""
    found = _with_previous(years).where("own_prev is null or own_prev <> prev_year")
    return found.select("tech", "year", "actor")


def persisting_intersect(years: DataFrame) -> DataFrame:
    """(tech, year, actor): actors of a year that were there in the active year before, too."""
    return _with_previous(years).where("own_prev = prev_year").select("tech", "year", "actor")


def actor_timeline(years: DataFrame, n: int = 10) -> DataFrame:
    """Strongest actors with their active years (a year list is at most the window long)."""
    totals = years.groupBy("tech", "actor").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_set("year")).alias("years_active")
    )
    return top_k(totals, n, "total", ["actor"])
