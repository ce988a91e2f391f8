"""Top-k per technology and ordered outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int | None, by: str, ties: list[str], rank: str | None = None) -> DataFrame:
    """The ``k`` rows with the largest ``by`` per technology, ties by ``ties`` ascending.

    Spark cuts every partition to ``k`` rows per technology before it shuffles
    (WindowGroupLimit), so a technology that holds most rows does not end up in one task.
    """
    if k is None:
        return df
    name = rank or "_rank"
    w = Window.partitionBy("tech").orderBy(F.desc(by), *[F.asc(t) for t in ties])
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def europe_first(countries: DataFrame, dimension: DataFrame, limit: int = 15) -> DataFrame:
    """Top countries without office codes, European ones first, each group by total."""
    known = countries.join(dimension, "country", "left").where(
        ~F.coalesce(F.col("is_office"), F.lit(False))
    )
    top = top_k(known, limit, "total", ["country"])
    w = Window.partitionBy("tech").orderBy(F.desc("is_european"), F.desc("total"), "country")
    return top.withColumn("is_european", F.coalesce("is_european", F.lit(False))).select(
        "tech",
        F.row_number().over(w).alias("position"),
        "country",
        F.coalesce("label", "country").alias("label"),
        "is_european",
        "total",
    )


def top_papers(papers: DataFrame, n: int = 10) -> DataFrame:
    """Most cited papers with their first three authors."""
    short = F.array_join(F.transform(F.slice("authors", 1, 3), lambda a: a["name"]), ", ")
    top = top_k(
        papers.withColumn("citations", F.coalesce("citations", F.lit(0))), n, "citations", ["paper_id"], "position"
    )
    return top.select(
        "tech",
        "position",
        "paper_id",
        "title",
        "venue",
        "year",
        "citations",
        F.when(F.size("authors") > 3, F.concat(short, F.lit(" et al."))).otherwise(short).alias("authors_short"),
    )


def filter_sort(df: DataFrame, needle: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Rows containing ``needle`` in any of the columns (ignoring case), ordered."""
    from techatlas.operators.match import contains_text

    return contains_text(df, columns, needle).orderBy(*order)
