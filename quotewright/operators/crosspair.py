"""Cross-currency factor: eight pairs' one-bar returns at one boundary, currency strengths, residuals and their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import BAR, PAIRS

WINDOWED = ("base_strength", "quote_strength", "residual", "residual_dispersion")
COLUMNS = tuple(f"{n}_{k}" for n in WINDOWED for k in (("1", "sum_3", "sum_12") if n != "residual_dispersion" else ("1", "mean_3", "mean_12")))


def sections(bars: DataFrame, time: str = "bar_end") -> DataFrame:
    """(boundary, symbols present, missing symbols in canonical order, complete), one row for each boundary with a bar."""
    present = F.collect_set("symbol")
    missing = F.array_except(F.array(*[F.lit(p) for p in PAIRS]), present)
    out = bars.groupBy(F.col(time).alias("boundary")).agg(F.countDistinct("symbol").alias("present"), missing.alias("m"))
    return out.select("boundary", "present", F.concat_ws(",", "m").alias("missing_symbols"), (F.size("m") == 0).alias("complete"))


def returns_at(features: DataFrame) -> DataFrame:
    """(boundary, one return column a pair): boundaries where all eight returns are known."""
    wide = features.groupBy(F.col("bar_end").alias("boundary")).agg(*[F.max(F.when(F.col("symbol") == p, F.col("mid_return_1"))).alias(p) for p in PAIRS])
    known = F.lit(True)
    for p in PAIRS:
        known = known & F.col(p).isNotNull()
    return wide.where(known)


def solve(returns: DataFrame) -> DataFrame:
    """Adds ``strength_*``, ``residual_*`` and ``dispersion``; the order of operations is fixed."""
    c = F.col
    out = returns.withColumn("strength_JPY", (-c("EURJPY") - c("GBPJPY") + c("EURUSD") + c("GBPUSD") - 2 * c("USDJPY")) / 4)
    out = out.withColumns({"strength_AUD": c("AUDUSD"), "strength_CAD": -c("USDCAD"), "strength_EUR": (c("EURJPY") + c("EURUSD") + c("strength_JPY")) / 2, "strength_GBP": (c("GBPJPY") + c("GBPUSD") + c("strength_JPY")) / 2})
    out = out.withColumn("strength_CHF", c("strength_EUR") - c("EURCHF"))
    out = out.withColumns({f"residual_{p}": c(p) - (strength(p[:3]) - strength(p[3:])) for p in PAIRS})
    mean = _sum([c(f"residual_{p}") for p in PAIRS]) / 8
    squares = _sum([(c(f"residual_{p}") - mean) * (c(f"residual_{p}") - mean) for p in PAIRS])
    return out.withColumn("dispersion", F.sqrt(squares / 8))


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def strength(currency: str) -> Column:
    return F.lit(0.0) if currency == "USD" else F.col(f"strength_{currency}")


def factor_solution(features: DataFrame) -> DataFrame:
    """(boundary, symbol, base_strength, quote_strength, residual, residual_dispersion)."""
    cells = [F.struct(F.lit(p).alias("symbol"), strength(p[:3]).alias("base_strength"), strength(p[3:]).alias("quote_strength"), F.col(f"residual_{p}").alias("residual")) for p in PAIRS]
    return solve(returns_at(features)).select("boundary", F.explode(F.array(*cells)).alias("x"), F.col("dispersion").alias("residual_dispersion")).select("boundary", "x.*", "residual_dispersion")


def cross_pair_features(features: DataFrame) -> DataFrame:
    """The twelve cross-pair columns for each complete boundary and pair; sums and means are null until their window is full.

    A window is full when the boundaries of the last 3 or 12 steps all have a solution, so each solution is sent
    to the steps it counts for and grouped there: no ordering over the whole time line is needed.
    """
    solved = factor_solution(features)
    steps = solved.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("boundary", F.col("boundary") + F.col("back").cast("long") * BAR)
    aggregates = [F.max(F.when(F.col("back") == 0, F.col(n))).alias(f"{n}_1") for n in WINDOWED]
    for size in (3, 12):
        inside = F.col("back") < size
        for n in WINDOWED:
            total = F.sum(F.when(inside, F.col(n)))
            label = f"sum_{size}" if n != "residual_dispersion" else f"mean_{size}"
            aggregates.append(F.when(F.count_if(inside) == size, total if n != "residual_dispersion" else total / size).alias(f"{n}_{label}"))
    out = steps.groupBy("boundary", "symbol").agg(F.count_if(F.expr("back = 0")).alias("here"), *aggregates)
    return out.where("here = 1").select("boundary", "symbol", *COLUMNS)
