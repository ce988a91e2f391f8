"""Proportional sampling by year with an exact target size, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techatlas.session import materialize


def allocate(strata: DataFrame, target: int, census_threshold: int = 5) -> DataFrame:
    """(tech, year, pop) to (…, take): small strata whole, the others in proportion.

    What rounding down leaves over goes to the largest remainders (ties: earlier year), so the
    takes of a technology add up to ``target``. Integer arithmetic, hence no rounding noise.
    """
    if target < 1:
        raise ValueError("target must be at least 1")
    w = Window.partitionBy("tech")
    census = F.col("pop") <= census_threshold
    frame = (
        strata.withColumn("census_size", F.coalesce(F.sum(F.when(census, F.col("pop"))).over(w), F.lit(0)))
        .withColumn("population", F.sum("pop").over(w))
        .withColumn("room", F.lit(target) - F.col("census_size"))
        .withColumn("rest", F.col("population") - F.col("census_size"))
        .withColumn("share", F.floor(F.try_divide(F.col("room") * F.col("pop"), F.col("rest"))).cast("long"))
        .withColumn("share", F.when(~census & (F.col("room") > 0), F.expr("(room * pop) div rest")))
        .withColumn("remainder", F.when(F.col("share").isNotNull(), F.expr("(room * pop) % rest")))
        .withColumn("left_over", F.col("room") - F.sum("share").over(w))
        .withColumn(
            "_order", F.row_number().over(w.orderBy(F.desc_nulls_last("remainder"), "year"))
        )
    )
    take = (
        F.when(F.col("population") <= target, F.col("pop"))
        .when(census, F.col("pop"))
        .when(F.col("room") <= 0, F.lit(0))
        .otherwise(F.col("share") + F.when(F.col("_order") <= F.col("left_over"), 1).otherwise(0))
    )
    return frame.select("tech", "year", "pop", "population", take.cast("long").alias("take"))


def strata(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tech", "year").agg(F.count("*").alias("pop"))


def strata_report(rows: DataFrame, target: int, census_threshold: int = 5) -> DataFrame:
    """Population and sample per year, whether taken whole, and the sampling fraction."""
    plan = allocate(strata(rows), target, census_threshold)
    taken = F.sum("take").over(Window.partitionBy("tech"))
    return plan.select(
        "tech",
        "year",
        "pop",
        "take",
        (F.col("take") >= F.col("pop")).alias("is_census"),
        F.round(taken / F.col("population"), 4).alias("sampling_fraction"),
    )


def stratum_index(rows: DataFrame, row_id: str) -> DataFrame:
    """Add ``_idx``, the zero-based position of each row in its (tech, year) by ``row_id``.

    Rows are dealt into sorted ranges of about equal size, whatever the ids are (hashes, outliers,
    text). A row's position is the number of rows of its stratum in earlier ranges (a small table) plus its
    position in its own range, so a stratum that holds a third of all rows is ranked by many tasks.
    The ranges are written first, so that both counts see the same ones.
    """
    keys = ["tech", "year"]
    ranged = rows.repartitionByRange(*keys, row_id).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(row_id))
    return (
        ranged.withColumn("_pos", inside)
        .join(offsets, [*keys, "_range"])
        .withColumn("_idx", F.col("_offset") + F.col("_pos") - 1)
        .drop("_pos", "_offset", "_range")
    )


def is_picked(idx: Column, pop: Column, take: Column) -> Column:
    """Whether a position is one of ``int(step/2 + j·step)``, j = 0 … take-1, step = pop/take."""
    step = pop / F.nullif(take, F.lit(0))
    start = step / 2.0
    guess = F.floor((idx - start) / step)
    hits = [
        (guess + d >= 0) & (guess + d < take) & (F.floor(start + (guess + d) * step) == idx) for d in (0, 1, 2)
    ]
    return (take >= pop) | F.coalesce(hits[0] | hits[1] | hits[2], F.lit(False))


def stratified_sample(rows: DataFrame, row_id: str, target: int, census_threshold: int = 5) -> DataFrame:
    """Rows ``(tech, year, row_id, …)`` sampled to ``target`` per technology."""
    plan = allocate(strata(rows), target, census_threshold).select("tech", "year", "pop", "take")
    placed = stratum_index(rows, row_id).join(plan, ["tech", "year"])
    return placed.where(is_picked(F.col("_idx"), F.col("pop"), F.col("take"))).drop("_idx", "pop", "take")
