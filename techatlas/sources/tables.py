"""Canonical tables, and how the star-schema test data maps onto them.

Every table is a lazy DataFrame. A user with real patent or project tables fills ``Tables``
with their own DataFrames of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from techatlas.functions.names import code_set

#: Search phrases of the registered queries, each with its year window.
TERMS = [
    ("hot anvil", "hot anvil", 1995, 2001),
    ("cold bolt", "Cold-Bolt", 1995, 2001),
    ("blue", "blue", 1995, 2001),
    ("large ring", "large ring", 1996, 2000),
    ("of the", "of the", 1995, 2001),
    ("est", "est", 1995, 2001),
]


def terms_table(spark: SparkSession, terms=None) -> DataFrame:
    """``terms(tech, query, start_year, end_year)``, one row per technology.

    Built from an Arrow table, so Spark knows its exact size when it plans joins.
    """
    rows = TERMS if terms is None else terms
    tech, query, start, end = zip(*rows)
    return spark.createDataFrame(
        pa.table(
            {
                "tech": pa.array(tech, pa.string()),
                "query": pa.array(query, pa.string()),
                "start_year": pa.array(start, pa.int32()),
                "end_year": pa.array(end, pa.int32()),
            }
        )
    )


def country_code(nationkey: str) -> Column:
    """Two letters for a nation key."""
    return F.concat(F.lit("N"), F.char(F.lit(65) + F.col(nationkey)))


class Tables:
    """The canonical tables of the analyses, by name.

    ``records, record_actor, record_code, projects, organizations, papers, publications,
    lei_reference`` are given as DataFrames, or as functions that are called on first use.
    """

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]):
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._sources:
            raise AttributeError(name)
        source = self._sources[name]
        table = source if isinstance(source, DataFrame) else source()
        setattr(self, name, table)
        return table


class StarSchema:
    """Canonical tables derived from the star-schema test tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        # reading the footer for the schema is a job of its own: once per table
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def order_text(self) -> DataFrame:
        """Text columns per order.

        The collected sets are bounded by their vocabularies (part names, brands and code
        strings), not by the number of lines, and Spark combines them before the shuffle.
        """
        code = F.concat(
            F.substring("p_type", 1, 1),
            F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 2, "0"),
            F.upper(F.substring("p_name", 1, 1)),
            F.lit(" "),
            F.col("p_size").cast("string"),
            F.lit("/00"),
        )

        def joined(c) -> Column:
            return F.array_join(F.sort_array(F.collect_set(c)), ", ")

        # a code is written once per part, not per line
        part = self.raw("part").select("p_partkey", "p_name", "p_brand", code.alias("code"))
        return (
            self.raw("lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_orderkey")
            .agg(
                joined("p_name").alias("title"),
                joined("p_brand").alias("keywords"),
                joined("code").alias("codes"),
            )
        )

    def records(self) -> DataFrame:
        """One record per order."""
        own = country_code("c_nationkey")
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.order_text(), F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.col("o_orderkey").alias("record_id"),
                F.concat(F.lit("EP"), "o_orderkey", F.lit("A1")).alias("publication_number"),
                own.alias("country"),
                "title",
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"),
                F.year("o_orderdate").alias("pub_year"),
                F.col("o_custkey").cast("string").alias("family_id"),
                F.concat(
                    F.col("c_name"),
                    F.when(F.col("o_orderstatus") == "F", " GmbH")
                    .when(F.col("o_orderstatus") == "O", " Corp.")
                    .otherwise(" & Co. KG"),
                    F.lit(", "),
                    F.col("c_mktsegment"),
                    F.lit(" AG, "),
                    F.col("n_name"),
                    F.lit(" Institute"),
                ).alias("applicant_names"),
                F.concat_ws(
                    ", ",
                    own,
                    F.when(F.col("o_orderstatus") == "F", own).otherwise(country_code("n_regionkey")),
                    F.lit("x1y"),
                ).alias("applicant_countries"),
                "codes",
            )
        )

    def record_actor(self) -> DataFrame:
        """Distinct (record, actor) links: the suppliers of an order."""
        suffix = (
            F.when(F.col("s_suppkey") % 4 == 0, " GmbH")
            .when(F.col("s_suppkey") % 4 == 1, " Co., Ltd.")
            .when(F.col("s_suppkey") % 4 == 2, " AG")
            .otherwise("")
        )
        return (
            self.raw("lineitem")
            .select(F.col("l_orderkey").alias("record_id"), "l_suppkey")
            .distinct()
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                "record_id",
                F.col("s_suppkey").alias("actor_id"),
                F.concat("s_name", suffix).alias("raw_name"),
                F.col("s_name").alias("name"),
                country_code("s_nationkey").alias("actor_country"),
            )
        )

    def record_code(self, level: int = 4) -> DataFrame:
        return record_code_links(self.records(), level)

    def projects(self) -> DataFrame:
        """One project per order."""
        framework = F.substring("o_orderpriority", 1, 1)
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.order_text(), F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.col("o_orderkey").alias("project_id"),
                F.when(framework == "1", "FP7")
                .when(framework.isin("2", "5"), "H2020")
                .when(framework == "3", "HORIZON")
                .alias("framework"),
                F.concat(F.lit("PRJ"), "o_orderkey").alias("acronym"),
                "title",
                F.concat(F.lit("Work for the "), F.lower("c_mktsegment"), F.lit(" sector")).alias("objective"),
                "keywords",
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
                F.year("o_orderdate").alias("start_year"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_totalprice").alias("total_cost"),
                F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("ec_max_contribution"),
                F.col("c_mktsegment").alias("funding_scheme"),
            )
        )

    def organizations(self) -> DataFrame:
        """One row per (project, organisation)."""
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("project_id"), "l_suppkey")
            .agg(F.min("l_linenumber").alias("first_line"))
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                "project_id",
                F.col("s_name").alias("name"),
                country_code("s_nationkey").alias("country"),
                F.concat("r_name", F.lit("-"), (F.col("s_suppkey") % 10).cast("string")).alias("city"),
                F.when(F.col("first_line") == 1, "coordinator").otherwise("participant").alias("role"),
                F.when(F.col("s_acctbal") < 2000, "YES").otherwise("no").alias("sme"),
            )
        )

    def papers(self) -> DataFrame:
        """One paper per part; its line items are its citations."""
        cited = (
            self.raw("lineitem")
            .groupBy("l_partkey")
            .agg(
                F.min(F.year("l_shipdate")).alias("year"),
                F.count("*").alias("citations"),
                F.count_if(F.col("l_returnflag") == "R").alias("influential"),
            )
        )
        authors = F.array(
            F.col("p_brand"),
            F.col("p_type"),
            F.concat(F.lit("Author "), F.col("p_size").cast("string")),
            F.col("p_name"),
        )
        return (
            self.raw("part")
            .join(cited, F.col("p_partkey") == F.col("l_partkey"), "left")
            .select(
                F.col("p_partkey").alias("paper_id"),
                F.col("p_name").alias("title"),
                F.when(F.col("p_size") > 2, F.col("p_brand")).alias("venue"),
                "year",
                "citations",
                "influential",
                F.transform(
                    F.slice(authors, F.lit(1), F.col("p_size") % 4 + 1), lambda a: F.struct(a.alias("name"))
                ).alias("authors"),
                F.when(F.col("p_size") > 25, F.array(F.col("p_type"), F.lit("Review")))
                .otherwise(F.array(F.col("p_type")))
                .alias("publication_types"),
            )
        )

    def publications(self) -> DataFrame:
        """One publication per document."""
        return self.raw("documents").select(
            F.col("doc_id").alias("publication_id"),
            F.col("text").alias("title"),
            (F.lit(1995) + F.col("doc_id") % 7).cast("int").alias("year"),
        )

    def lei_reference(self) -> DataFrame:
        """Legal-entity answers: two per supplier, some expired, some negative."""
        base = self.raw("supplier").select(
            F.col("s_name").alias("raw_name"),
            F.concat(F.lit("LEI"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("code"),
            F.concat("s_name", F.lit(" Group")).alias("legal_name"),
            country_code("s_nationkey").alias("country"),
            F.date_sub(F.lit("2001-08-01").cast("date"), (F.col("s_suppkey") % 120).cast("int")).alias("newer"),
            "s_acctbal",
        )
        positive = F.col("s_acctbal") >= 0
        newer = base.select(
            "raw_name",
            F.when(positive, F.col("code")).alias("lei"),
            F.when(positive, F.col("legal_name")).alias("legal_name"),
            F.when(positive, F.col("country")).alias("country"),
            F.col("newer").alias("resolved_at"),
        )
        older = base.select(
            "raw_name",
            F.concat(F.col("code"), F.lit("-OLD")),
            "legal_name",
            "country",
            F.date_sub("newer", 30),
        )
        return newer.unionAll(older)

    def code_dimension(self) -> DataFrame:
        """``(code, description)`` of sections, classes and some subclasses."""
        part = self.raw("part").select(
            F.substring("p_type", 1, 1).alias("sec"),
            F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 2, "0").alias("cls"),
            F.upper(F.substring("p_name", 1, 1)).alias("sub"),
            "p_type",
            "p_brand",
            "p_name",
            "p_size",
        )
        sections = part.groupBy(F.col("sec").alias("code")).agg(F.max("p_type").alias("description"))
        classes = (
            part.where("p_size > 48")
            .groupBy(F.concat("sec", "cls").alias("code"))
            .agg(F.max(F.concat_ws(" ", "p_type", "p_brand")).alias("description"))
        )
        subclasses = (
            part.where("p_size = 50")
            .groupBy(F.concat("sec", "cls", "sub").alias("code"))
            .agg(F.max(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("description"))
        )
        return sections.unionAll(classes).unionAll(subclasses)

    def country_dimension(self) -> DataFrame:
        """``(country, label, is_european, is_office)`` from nation and region."""
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                country_code("n_nationkey").alias("country"),
                F.col("n_name").alias("label"),
                (F.col("r_name") == "EUROPE").alias("is_european"),
                (F.col("n_nationkey") == 24).alias("is_office"),
            )
        )

    def tables(self) -> Tables:
        names = (
            "records", "record_actor", "record_code", "projects", "organizations", "papers", "publications",
            "lei_reference",
        )
        return Tables(**{n: getattr(self, n) for n in names})


def record_code_links(records: DataFrame, level: int = 4, min_codes: int = 2) -> DataFrame:
    """(record_id, code, pub_year) links of dated records with at least two codes; no shuffle."""
    return (
        records.where("pub_year is not null")
        .select("record_id", "pub_year", code_set("codes", level).alias("code_list"))
        .where(F.size("code_list") >= min_codes)
        .select("record_id", F.explode("code_list").alias("code"), "pub_year")
    )
