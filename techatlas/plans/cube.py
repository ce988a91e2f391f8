"""The year cube of classification codes as a table: any span of years without touching records.

Two tables, in a folder per technology and year: ``pairs`` (a, b, n: records that carry both codes) and ``codes``
(code, n), of all codes. A record has one year, so counts of a span are sums of yearly ones. A span reads
the folders of its technologies and years only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from techatlas.operators import codes as co
from techatlas.operators import pairs as pr
from techatlas.plans.analysis import Analysis

PAIRS = "a string, b string, n long, tech string, pub_year int"
CODES = "code string, n long, tech string, pub_year int"


def write(an: Analysis, out: str, level: int = 4) -> None:
    """Write the cube of an analysis below ``out``; technologies and years it holds are replaced, others stay."""
    tables = {
        "pairs": pr.pairs_codes_year_of(an.records, level),
        "codes": co.codes_by_year(co.code_links_of(an.records, level)),
    }
    for name, table in tables.items():
        # counts are few beside records: one file for each technology and year
        table = table.repartition("tech", "pub_year")
        writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("tech", "pub_year").parquet(f"{out}/{name}")


def _read(spark: SparkSession, out: str, name: str, schema: str, techs: Sequence[str] | None) -> DataFrame:
    table = spark.read.schema(schema).parquet(f"{out}/{name}")
    return table if techs is None else table.where(F.col("tech").isin(list(techs)))


def pairs(spark: SparkSession, out: str, techs: Sequence[str] | None = None) -> DataFrame:
    """(tech, pub_year, a, b, n) of all codes."""
    return _read(spark, out, "pairs", PAIRS, techs).select("tech", "pub_year", "a", "b", "n")


def codes(spark: SparkSession, out: str, techs: Sequence[str] | None = None) -> DataFrame:
    """(tech, pub_year, code, n) of all codes."""
    return _read(spark, out, "codes", CODES, techs).select("tech", "pub_year", "code", "n")


def window(
    spark: SparkSession, out: str, first: int, last: int, n: int = 15, techs: Sequence[str] | None = None
) -> DataFrame:
    """Jaccard of the n most frequent codes of the years ``first`` to ``last``."""
    return co.code_jaccard_window(pairs(spark, out, techs), codes(spark, out, techs), first, last, n)


def year_maps(spark: SparkSession, out: str, listed: DataFrame) -> DataFrame:
    """Per technology the listed codes' counts as nested maps: year -> "a|b" -> n and year -> code -> n.

    ``listed``: (tech, code), some codes per technology; with k codes a map holds at most k^2 / 2 pairs a year.
    """
    some = listed.select("tech", "code").distinct()
    both = (
        pairs(spark, out)
        .join(some.withColumnRenamed("code", "a"), ["tech", "a"], "left_semi")
        .join(some.withColumnRenamed("code", "b"), ["tech", "b"], "left_semi")
        .select("tech", "pub_year", F.concat("a", F.lit("|"), "b").alias("key"), "n")
    )
    single = codes(spark, out).join(some, ["tech", "code"], "left_semi").withColumnRenamed("code", "key")

    def nested(table: DataFrame, name: str) -> DataFrame:
        years = table.groupBy("tech", "pub_year").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("_rows"))
        entries = F.array_sort(F.collect_list(F.struct("pub_year", "_rows")))
        by_year = years.groupBy("tech").agg(entries.alias("_years"))
        one = F.transform("_years", lambda y: F.struct(y["pub_year"], F.map_from_entries(y["_rows"])))
        return by_year.select("tech", F.map_from_entries(one).alias(name))

    return nested(single, "code_counts").join(nested(both, "pair_counts"), "tech", "left")
