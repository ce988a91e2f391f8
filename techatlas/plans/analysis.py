"""The search results of one batch of technologies, shared by all analyses."""

from __future__ import annotations

import threading
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techatlas.operators import aggregate as ag
from techatlas.operators.codes import code_sets_of, links_of_sets
from techatlas.operators.match import match_phrase
from techatlas.session import materialize
from techatlas.sources.tables import Tables

RECORD_FIELDS = ["title", "codes"]
PROJECT_FIELDS = ["title", "objective", "keywords"]

#: What is written of a hit; a lazy match table carries all columns, as they can be pruned.
RECORD_COLUMNS = ["record_id", "country", "pub_year", "family_id", "applicant_countries", "codes"]
ACTOR_COLUMNS = ["tech", "record_id", "pub_year", "actor"]
PROJECT_COLUMNS = ["project_id", "start_year", "framework", "funding_scheme", "ec_max_contribution"]


class shared(cached_property):
    """A property that is made once, also when several threads ask for it at a time; one that fails is tried again."""

    def __get__(self, instance, owner=None):
        if instance is None:
            return self
        with instance.locks.setdefault(self.attrname, threading.RLock()):
            return super().__get__(instance, owner)


class Analysis:
    """Match tables for ``terms`` over ``tables``.

    ``clamp`` cuts the year window of records at their last full year, as the panels do.
    With ``materialized`` every match table is written once to the shared folder when it is
    first used; the panels then read the hits, not the corpora. Without it all tables are
    lazy, and only the columns an analysis uses are carried.
    """

    def __init__(self, tables: Tables, terms: DataFrame, clamp: bool = False, materialized: bool = False):
        self.tables = tables
        self.terms = terms
        self.clamp = clamp
        self.materialized = materialized
        self.locks: dict[str, threading.RLock] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.materialized else df

    def _columns(self, table: DataFrame, needed: list[str]) -> list[str]:
        return [c for c in table.columns if c in needed] if self.materialized else table.columns

    @shared
    def last_full_record_year(self) -> DataFrame:
        return self.keep(ag.last_full_year(self.tables.records, "pub_date"), "last-year")

    @shared
    def last_full_project_year(self) -> DataFrame:
        return self.keep(ag.last_full_year(self.tables.projects, "start_date"), "last-year")

    @shared
    def all_records(self) -> DataFrame:
        """(tech, record columns …) in the window asked for."""
        columns = self._columns(self.tables.records, RECORD_COLUMNS)
        found = match_phrase(self.tables.records, self.terms, RECORD_FIELDS, columns, "pub_year")
        return self.keep(found, "records")

    @shared
    def records(self) -> DataFrame:
        """Hits in the window, up to the last full year if clamped."""
        if not self.clamp:
            return self.all_records
        return self.all_records.where(F.col("pub_year") <= self.last_full_record_year.scalar())

    @shared
    def record_actors(self) -> DataFrame:
        slim = self.records.select("tech", "record_id", "pub_year")
        found = ag.record_actors(slim, self.tables.record_actor)
        return self.keep(found.select(*self._columns(found, ACTOR_COLUMNS)), "record-actors")

    @shared
    def code_sets(self) -> DataFrame:
        """(tech, record_id, pub_year, code_list): the code texts are cut once."""
        return self.keep(code_sets_of(self.records), "code-sets")

    @shared
    def code_links(self) -> DataFrame:
        return links_of_sets(self.code_sets)

    @shared
    def projects(self) -> DataFrame:
        columns = self._columns(self.tables.projects, PROJECT_COLUMNS)
        found = match_phrase(self.tables.projects, self.terms, PROJECT_FIELDS, columns, "start_year")
        return self.keep(found, "projects")

    @shared
    def project_orgs(self) -> DataFrame:
        slim = self.projects.select("tech", "project_id", "start_year", "framework")
        return self.keep(ag.project_orgs(slim, self.tables.organizations), "project-orgs")

    @shared
    def country_sets(self) -> DataFrame:
        """(tech, project_id, countries)."""
        return self.keep(ag.country_sets(self.project_orgs), "country-sets")

    @shared
    def project_countries(self) -> DataFrame:
        """(tech, country, n) of all projects."""
        return self.keep(ag.projects_by_country_of(self.country_sets), "project-countries")

    @shared
    def filing_countries(self) -> DataFrame:
        """(tech, country, n) of all records."""
        return self.keep(ag.records_by_country(self.records, None), "filing-countries")

    @shared
    def instruments(self) -> DataFrame:
        """(tech, scheme, year, n, funding) of all projects."""
        return self.keep(ag.funding_by_instrument(self.projects), "instruments")

    @shared
    def publications_by_year(self) -> DataFrame:
        found = match_phrase(
            self.tables.publications, self.terms, ["title"], ["publication_id", "year"], "year"
        )
        return self.keep(found.groupBy("tech", "year").agg(F.count("*").alias("n")), "publications")

    @shared
    def papers(self) -> DataFrame:
        """All matching papers."""
        found = match_phrase(self.tables.papers, self.terms, ["title"], self.tables.papers.columns, "year")
        return self.keep(found.withColumn("citations", F.coalesce("citations", F.lit(0))), "papers")
