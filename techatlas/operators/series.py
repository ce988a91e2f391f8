"""Yearly series: complete year spines, growth, running totals, growth rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_spine(terms: DataFrame) -> DataFrame:
    """(tech, year) for every year of each window."""
    return terms.select("tech", F.explode(F.sequence("start_year", "end_year")).alias("year"))


def union_years(terms: DataFrame, *series: DataFrame) -> DataFrame:
    """Spine years plus all years seen in the series, cut to the window."""
    years = year_spine(terms)
    for s in series:
        inside = s.join(terms, "tech").where("year between start_year and end_year")
        years = years.unionAll(inside.select("tech", "year"))
    return years.distinct()


def spine_left_join(terms: DataFrame, series: DataFrame, value: str = "n") -> DataFrame:
    """The series on the complete spine, zero where it has no row."""
    return (
        year_spine(terms)
        .join(series, ["tech", "year"], "left")
        .select("tech", "year", F.coalesce(value, F.lit(0)).alias(value))
    )


def merge_series(terms: DataFrame, records: DataFrame, projects: DataFrame, publications: DataFrame) -> DataFrame:
    """Three yearly series side by side on the complete spine.

    The inputs are tiny yearly counts; one union and one aggregate replace three joins.
    """
    names = ("records", "projects", "publications")
    tagged = [
        s.select("tech", "year", *[(F.col("n") if a == b else F.lit(0)).cast("long").alias(b) for b in names])
        for a, s in zip(names, (records, projects, publications))
    ]
    spine = year_spine(terms).select("tech", "year", *[F.lit(0).cast("long").alias(b) for b in names])
    stacked = spine
    for t in tagged:
        stacked = stacked.unionAll(t.join(terms, "tech", "left_semi"))
    bounds = terms.select("tech", "start_year", "end_year")
    return (
        stacked.groupBy("tech", "year")
        .agg(*[F.sum(b).alias(b) for b in names])
        .join(bounds, "tech")
        .where("year between start_year and end_year")
        .select("tech", "year", *names)
    )


def _by_year() -> Window:
    return Window.partitionBy("tech").orderBy("year")


def growth(current: Column, previous: Column) -> Column:
    """Change in percent with one decimal; null if there is no previous value or it is zero."""
    return F.round((current - previous) / F.nullif(previous, F.lit(0)) * 100, 1)


def yoy_growth(series: DataFrame, values: list[str]) -> DataFrame:
    w = _by_year()
    return series.select(
        "*", *[growth(F.col(v), F.lag(v).over(w)).alias(f"{v}_growth") for v in values]
    )


def cumulative(series: DataFrame, value: str = "n") -> DataFrame:
    w = _by_year().rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("cumulative", F.sum(value).over(w))


def cagr(first: Column, last: Column, periods: Column) -> Column:
    """Compound annual growth rate in percent, 0 for invalid input."""
    valid = (periods > 0) & (first > 0) & (last > 0)
    return F.when(valid, (F.pow(last / first, F.lit(1.0) / periods) - 1) * 100).otherwise(F.lit(0.0))


def series_cagr(series: DataFrame, value: str, last_year: Column | None = None) -> DataFrame:
    """CAGR between the first and the last non-zero year (up to ``last_year``) per technology."""
    used = series.where(F.col(value) > 0)
    if last_year is not None:
        used = used.where(F.col("year") <= last_year)
    ends = used.groupBy("tech").agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min_by(value, "year").alias("first_value"),
        F.max_by(value, "year").alias("last_value"),
    )
    rate = cagr(F.col("first_value"), F.col("last_value"), F.col("last_year") - F.col("first_year"))
    return ends.select(
        "tech",
        "first_year",
        "last_year",
        F.round(rate, 2).alias("cagr"),
        F.when(
            F.col("last_year") > F.col("first_year"), F.concat_ws("-", "first_year", "last_year")
        ).otherwise("").alias("period"),
    )


def trend_features(series: DataFrame, value: str = "n") -> DataFrame:
    """Halves of each series compared, growth of the last three years, spread of the second half."""
    w = Window.partitionBy("tech")
    rn = F.row_number().over(_by_year())
    # half of the length, at least one year in the first half
    ranked = series.select(
        "tech", "year", F.col(value).alias("v"), rn.alias("rn"), F.count("*").over(w).alias("len")
    ).withColumn("mid", F.floor(F.col("len") / 2))
    first = F.col("rn") <= F.greatest("mid", F.lit(1))
    second = F.col("rn") > F.col("mid")
    feats = ranked.groupBy("tech").agg(
        F.count("*").alias("years"),
        F.sum("v").alias("total"),
        F.avg(F.when(first, F.col("v"))).alias("avg_first"),
        F.avg(F.when(second, F.col("v"))).alias("avg_second"),
        F.stddev_pop(F.when(second, F.col("v"))).alias("sd_second"),
        F.max(F.when(F.col("rn") == F.greatest(F.col("len") - 2, F.lit(1)), F.col("v"))).alias("recent_first"),
        F.max(F.when(F.col("rn") == F.col("len"), F.col("v"))).alias("recent_last"),
    )
    recent = F.when(
        (F.col("years") >= 2) & (F.col("recent_first") > 0),
        (F.col("recent_last") - F.col("recent_first")) / F.col("recent_first"),
    ).otherwise(0.0)
    overall = (
        F.when(F.col("avg_first") > 0, (F.col("avg_second") - F.col("avg_first")) / F.col("avg_first"))
        .when(F.col("avg_second") > 0, 1.0)
        .otherwise(0.0)
    )
    cv = F.when(F.col("avg_second") > 0, F.col("sd_second") / F.col("avg_second")).otherwise(1.0)
    return feats.select(
        "tech",
        "years",
        "total",
        "avg_first",
        "avg_second",
        recent.alias("recent_growth"),
        overall.alias("overall_growth"),
        cv.alias("variation"),
    )


def heuristic_phase(features: DataFrame) -> DataFrame:
    """Maturity phase and confidence from the trend features alone."""
    o, r, cv = F.col("overall_growth"), F.col("recent_growth"), F.col("variation")

    def capped(c: Column) -> Column:
        return F.round(F.least(F.lit(0.9), c), 2)

    empty = (F.col("years") < 3) | (F.col("total") == 0)
    rules = [
        (empty, "Unknown", F.lit(0.0)),
        ((o > 0.5) & (r > 0.1), "Emerging", capped(0.5 + o * 0.3)),
        ((o > 0.1) & (r > -0.1), "Growing", capped(0.5 + (1 - cv) * 0.3)),
        ((F.abs(o) <= 0.2) & (cv < 0.4), "Mature", capped(0.6 + (1 - cv) * 0.3)),
        ((o < -0.1) | (r < -0.2), "Declining", capped(0.5 + F.abs(o) * 0.3)),
    ]
    phase = F.when(rules[0][0], rules[0][1])
    conf = F.when(rules[0][0], rules[0][2])
    for cond, label, value in rules[1:]:
        phase = phase.when(cond, label)
        conf = conf.when(cond, value)
    return features.select(
        "tech", phase.otherwise("Growing").alias("phase"), conf.otherwise(F.lit(0.4)).alias("confidence")
    )


def maturity_phase(percent: Column) -> Column:
    """Phase from the share of the saturation level reached."""
    return (
        F.when(percent < 10, "Emerging")
        .when(percent < 50, "Growing")
        .when(percent < 90, "Mature")
        .when(percent.isNotNull(), "Saturation")
    )


def phase_confidence(r2: Column) -> Column:
    return F.round(F.least(F.lit(0.95), F.coalesce(F.nullif(r2, F.lit(0.0)), F.lit(0.5))), 2)


def fit_confidence(r2: Column, years: Column, total: Column) -> Column:
    raw = (
        F.coalesce(r2, F.lit(0.0)) * 0.6
        + F.least(F.lit(1.0), years / 15.0) * 0.2
        + F.least(F.lit(1.0), total / 200.0) * 0.2
    )
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.1), raw)), 2)
