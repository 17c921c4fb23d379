"""Causal rolling features of quote bars. A step between bars other than five minutes resets all windows.

Windows run by symbol over bars, not ticks: one shuffle of the bars, in which all features are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..contracts import BAR, FEATURES_V1, IMBALANCES
from .bars import UPDATES


def with_segments(bars: DataFrame, time: str = "bar_end", keys: tuple[str, ...] = ("symbol",), broken: Column | None = None) -> DataFrame:
    """Adds ``seg``, which counts the gaps so far, and ``step``, the time since the row before."""
    w = Window.partitionBy(*keys).orderBy(time)
    step = F.col(time) - F.lag(time).over(w)
    gap = F.coalesce(step != BAR, F.lit(True))
    rows = bars.withColumn("step", step).withColumn("__gap", (gap if broken is None else gap | broken).cast("long"))
    return rows.withColumn("seg", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")


def _segment(time: str = "bar_end", keys: tuple[str, ...] = ("symbol",)) -> WindowSpec:
    return Window.partitionBy(*keys, "seg").orderBy(time)


def when_full(value: Column, counted: Column | str, w: WindowSpec, size: int) -> Column:
    """``value`` over the last ``size`` rows, and null until that many non-null inputs are there."""
    return F.when(F.count(counted).over(w.rowsBetween(1 - size, 0)) == size, value)


def features_v1(bars: DataFrame, *carry: str) -> DataFrame:
    """The fifteen causal features of each bar."""
    w = _segment()
    close, x = F.col("mid_close"), F.col("spread_bps")
    rows = with_segments(bars).withColumn("spread_bps", F.col("spread_close") / close * 10_000)
    rows = rows.withColumn("mid_return_1", F.ln(close / F.lag("mid_close", 1).over(w)))
    last = w.rowsBetween(-71, 0)
    mean = F.sum(x).over(last) / 72
    # A constant window has no variance, whatever its sums round to.
    constant = F.max(x).over(last) == F.min(x).over(last)
    variance = F.greatest(F.sum(x * x).over(last) / 72 - mean * mean, F.lit(0.0))
    angle = 2 * F.pi() * F.pmod("bar_end", F.lit(86_400_000_000)).cast("double") / 86_400_000_000
    week = 2 * F.pi() * F.weekday(F.timestamp_micros("bar_end")) / 7
    square = F.col("mid_return_1") * F.col("mid_return_1")
    out = {
        "mid_return_1": F.col("mid_return_1"),
        "mid_return_3": F.ln(close / F.lag("mid_close", 3).over(w)),
        "mid_return_12": F.ln(close / F.lag("mid_close", 12).over(w)),
        **{f"realized_volatility_{n}": when_full(F.sqrt(F.sum(square).over(w.rowsBetween(1 - n, 0))), "mid_return_1", w, n) for n in (12, 72)},
        "spread_bps": x,
        "spread_zscore_72": when_full(F.when(~constant & (variance > 0), (x - mean) / F.sqrt(variance)).otherwise(F.lit(0.0)), "spread_bps", w, 72),
        "mid_range_bps": (F.col("mid_high") - F.col("mid_low")) / close * 10_000,
        "quote_count_log1p": F.log1p("quote_count"),
        "staleness_seconds": F.col("staleness_ns").cast("double") / 1e9,
        "elapsed_seconds": F.col("step").cast("double") / 1e6,
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "weekday_sin": F.sin(week),
        "weekday_cos": F.cos(week),
    }
    return rows.select("symbol", "bar_end", *[out[c].alias(c) for c in FEATURES_V1], *carry)


def features_v2(bars: DataFrame) -> DataFrame:
    """v1 and rolling imbalances (ratios of summed counts) and dispersions over 15 and 60 minutes; needs v2 bars."""
    base = features_v1(bars, "seg", *UPDATES, "interarrival_dispersion_seconds")
    w = _segment()
    more = []
    for size, label in ((3, "15m"), (12, "60m")):
        last = w.rowsBetween(1 - size, 0)
        for name, up, down in zip(IMBALANCES, UPDATES[::2], UPDATES[1::2], strict=True):
            a, b = F.sum(up).over(last).cast("double"), F.sum(down).over(last).cast("double")
            more.append(when_full(F.when(a + b != 0, (a - b) / (a + b)).otherwise(F.lit(0.0)), F.lit(1), w, size).alias(f"{name}_imbalance_{label}"))
        more.append(when_full(F.avg("interarrival_dispersion_seconds").over(last), "interarrival_dispersion_seconds", w, size).alias(f"interarrival_dispersion_seconds_{label}"))
    return base.select("symbol", "bar_end", *FEATURES_V1, *more)


def tail_context(bars: DataFrame, boundary: int, rows: int = 73) -> DataFrame:
    """The last ``rows`` bars of each symbol that end at or before the boundary."""
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_end"))
    return bars.where(F.col("bar_end") <= boundary).withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= rows).drop("__nth")
