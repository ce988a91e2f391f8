"""Logistic and Gompertz growth curves fitted to many cumulative series at once.

The curve is ``L · g(year; k, x0)``. For given k and x0 the best L is a closed form, so only
two parameters are searched: a grid over (log k, position of x0 in its bounds), zoomed in
round by round. A series is at most a few dozen years long and the whole search is one column
expression on its row: no shuffle, no Python, technologies fitted in parallel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grid points per axis, rounds, and half width of the next round in grid steps.
GRID, ROUNDS, ZOOM = 24, 8, 3

# Parameter bounds of the fit.
K_MIN, K_MAX = 0.001, 5.0
L_MIN, L_MAX = 0.5, 10.0
X0_MARGIN = 10.0
B_MIN, B_MAX = 0.1, 50.0
LN_K_MIN, LN_K_MAX = math.log(K_MIN), math.log(K_MAX)
LN_B_MIN, LN_B_MAX = math.log(B_MIN), math.log(B_MAX)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def curve(model: Column, k: Column, x0: Column, x: Column) -> Column:
    """Height of the unit curve; x0 is the inflection year of both models."""
    return _let(
        F.exp(-k * (x - x0)),
        lambda z: F.when(model == "Logistic", 1.0 / (1.0 + z)).otherwise(F.exp(-z)),
    )


def _candidate(lk: Column, u: Column) -> Column:
    """Struct (objective, lk, u, sse, sat, k, x0) of one grid point."""
    model, points = F.col("model"), F.col("points")
    gompertz = F.when(model == "Gompertz", 1.0).otherwise(0.0)

    def with_x0(p: Column) -> Column:
        low = F.col("first_x") - X0_MARGIN + gompertz * (LN_B_MIN / p["k"])
        high = F.col("last_x") + X0_MARGIN + gompertz * (LN_B_MAX / p["k"])
        x0 = low + p["u"] * (high - low)
        return F.struct(p["lk"].alias("lk"), p["u"].alias("u"), p["k"].alias("k"), x0.alias("x0"))

    def with_heights(p: Column) -> Column:
        heights = F.transform(
            points, lambda q: F.struct(q["y"].alias("y"), curve(model, p["k"], p["x0"], q["x"]).alias("g"))
        )
        return F.struct(*[p[c].alias(c) for c in ("lk", "u", "k", "x0")], heights.alias("h"))

    def with_sat(p: Column) -> Column:
        yg = F.aggregate(p["h"], F.lit(0.0), lambda s, q: s + q["y"] * q["g"])
        gg = F.aggregate(p["h"], F.lit(0.0), lambda s, q: s + q["g"] * q["g"])
        best = F.coalesce(F.try_divide(yg, gg), F.lit(0.0))
        sat = F.least(F.greatest(best, F.col("last_y") * L_MIN), F.col("last_y") * L_MAX)
        return F.struct(*[p[c].alias(c) for c in ("lk", "u", "k", "x0", "h")], sat.alias("sat"))

    def with_error(p: Column) -> Column:
        sse = F.aggregate(
            p["h"], F.lit(0.0), lambda s, q: s + (q["y"] - p["sat"] * q["g"]) * (q["y"] - p["sat"] * q["g"])
        )
        return _let(
            sse,
            lambda e: F.struct(
                F.round(e / F.col("sum_yy"), 12).alias("objective"),
                p["lk"].alias("lk"),
                p["u"].alias("u"),
                e.alias("sse"),
                p["sat"].alias("sat"),
                p["k"].alias("k"),
                p["x0"].alias("x0"),
            ),
        )

    start = F.struct(lk.alias("lk"), u.alias("u"), F.exp(lk).alias("k"))
    return _let(start, lambda a: _let(with_x0(a), lambda b: _let(with_heights(b), lambda c: _let(with_sat(c), with_error))))


def _round(lk_low: Column, lk_step: Column, u_low: Column, u_step: Column) -> Column:
    """Best candidate of one grid; ties by the smaller parameters."""

    def at(c: Column) -> Column:
        lk = lk_low + F.floor(c / GRID) * lk_step
        u = u_low + (c % GRID) * u_step
        lk = F.least(F.greatest(lk, F.lit(LN_K_MIN)), F.lit(LN_K_MAX))
        u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
        return _let(F.struct(lk.alias("lk"), u.alias("u")), lambda p: _candidate(p["lk"], p["u"]))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)), at))


def growth_curve_fit(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both models per series; input ``(keys, year, cumulative)``, at least three years.

    Returns ``keys, model, sat, k, x0, r2, maturity_percent, points`` where ``points`` holds
    the years and values fitted.
    """
    keys = keys or ["tech"]
    point = F.struct(F.col("year").cast("double").alias("x"), F.col("cumulative").cast("double").alias("y"))
    packed = (
        series.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(point)).alias("points"))
        .where(F.size("points") >= 3)
        .select(
            *keys,
            "points",
            F.element_at("points", 1)["x"].alias("first_x"),
            F.element_at("points", -1)["x"].alias("last_x"),
            F.element_at("points", -1)["y"].alias("last_y"),
            F.aggregate("points", F.lit(0.0), lambda s, q: s + q["y"] * q["y"]).alias("sum_yy"),
            (F.aggregate("points", F.lit(0.0), lambda s, q: s + q["y"]) / F.size("points")).alias("mean_y"),
            F.explode(F.array(F.lit("Logistic"), F.lit("Gompertz"))).alias("model"),
        )
        .where("last_y > 0")
    )
    # the rows are few bytes but long to compute: keep them spread out, a fixed number of
    # partitions is not merged at run time
    spread = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = packed.repartition(spread, *keys, "model")
    lk_step, u_step = (LN_K_MAX - LN_K_MIN) / (GRID - 1), 1.0 / (GRID - 1)
    # one expression for all rounds; its grid is given by four columns
    best = _round(F.col("_lk"), F.col("_lk_step"), F.col("_u"), F.col("_u_step"))
    fitted = packed.withColumns(
        {"_lk": F.lit(LN_K_MIN), "_lk_step": F.lit(lk_step), "_u": F.lit(0.0), "_u_step": F.lit(u_step)}
    ).withColumn("best", best)
    for _ in range(ROUNDS - 1):
        lows = {"_lk": F.col("best.lk") - ZOOM * lk_step, "_u": F.col("best.u") - ZOOM * u_step}
        lk_step, u_step = 2 * ZOOM * lk_step / (GRID - 1), 2 * ZOOM * u_step / (GRID - 1)
        fitted = fitted.withColumns(
            {**lows, "_lk_step": F.lit(lk_step), "_u_step": F.lit(u_step)}
        ).withColumn("best", best)
    ss_tot = F.aggregate(
        "points", F.lit(0.0), lambda s, q: s + (q["y"] - F.col("mean_y")) * (q["y"] - F.col("mean_y"))
    )
    r2 = F.coalesce(1.0 - F.try_divide(F.col("best.sse"), ss_tot), F.lit(0.0))
    return fitted.select(
        *keys,
        "model",
        F.round("best.sat", 2).alias("sat"),
        F.round("best.k", 6).alias("k"),
        F.round("best.x0", 2).alias("x0"),
        F.round(r2, 4).alias("r2"),
        F.round(F.least(F.lit(100.0), F.col("last_y") / F.col("best.sat") * 100), 2).alias("maturity_percent"),
        F.transform(
            "points",
            lambda q: F.struct(
                q["x"].cast("int").alias("year"),
                F.round(F.col("best.sat") * curve(F.col("model"), F.col("best.k"), F.col("best.x0"), q["x"]), 1).alias(
                    "fitted"
                ),
            ),
        ).alias("fitted_values"),
    )


def growth_model_select(fits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The model with the higher R²; logistic on a tie."""
    keys = keys or ["tech"]
    rest = [c for c in fits.columns if c not in keys]
    better = F.struct("r2", F.col("model") == "Logistic")
    return (
        fits.groupBy(*keys).agg(F.max_by(F.struct(*rest), better).alias("_f")).select(*keys, "_f.*")
    )


def fitted_values(fits: DataFrame) -> DataFrame:
    """(tech, year, fitted) of the selected models."""
    return fits.select("tech", F.explode("fitted_values").alias("_v")).select("tech", "_v.year", "_v.fitted")


def join_fitted_values(series: DataFrame, fits: DataFrame) -> DataFrame:
    """Each year of a series with its fitted value, null where none was fitted."""
    return series.join(fitted_values(fits), ["tech", "year"], "left")
