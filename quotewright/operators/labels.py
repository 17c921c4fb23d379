"""Forward executable labels: what a decision at a bar's end could have bought and sold at the next quotes due."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import HORIZONS, LATENCY, MINUTE
from ..functions.expressions import action


def check_horizons(horizons: tuple[int, ...], minimum_return_bps: float) -> None:
    if not horizons or list(horizons) != sorted(set(horizons)) or any(h <= 0 or h % 5 for h in horizons):
        raise ValueError("horizons must be ascending positive multiples of five minutes")
    if minimum_return_bps < 0:
        raise ValueError("the minimum return must not be negative")


def executable_labels(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, minimum_return_bps: float = 0.0) -> DataFrame:
    """One row for each bar: entry quote, and for each horizon exit time, long and short return and action.

    Bars lie on a grid and hold their first tick, so "first quote at or after t, five minutes late at most" is the next
    row for the entry and a range frame over bar starts for exits: no as-of join, one shuffle by symbol.
    An unresolved entry leaves all horizons null.
    """
    check_horizons(horizons, minimum_return_bps)
    w = Window.partitionBy("symbol").orderBy("bar_start")
    quote = F.struct("first_tick", "bid_open", "ask_open")
    exits = {h: F.first(quote).over(w.rangeBetween((5 + h) * MINUTE, (10 + h) * MINUTE)) for h in horizons}
    rows = bars.select("symbol", F.col("bar_end").alias("decision_time"), F.lead(quote).over(w).alias("__entry"), *[e.alias(f"__exit_{h}") for h, e in exits.items()])
    entry = F.when(F.col("__entry.first_tick") <= F.col("decision_time") + LATENCY, F.col("__entry"))
    rows = rows.withColumn("__entry", entry)
    out = [F.col("symbol"), F.col("decision_time"), F.col("__entry.first_tick").alias("entry_time"), F.col("__entry.bid_open").alias("entry_bid"), F.col("__entry.ask_open").alias("entry_ask")]
    for h in horizons:
        e = F.col(f"__exit_{h}")
        due = F.col("__entry").isNotNull() & (e["first_tick"] <= F.col("decision_time") + h * MINUTE + LATENCY)
        long = F.when(due, e["bid_open"] / F.col("__entry.ask_open") - 1)
        short = F.when(due, 1 - e["ask_open"] / F.col("__entry.bid_open"))
        out += [F.when(due, e["first_tick"]).alias(f"exit_time_{h}m"), long.alias(f"long_return_{h}m"), short.alias(f"short_return_{h}m"), F.when(due, action(long, short, minimum_return_bps / 10_000)).alias(f"action_{h}m")]
    return rows.select(*out)


def long_form(labels: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row for each decision and horizon that is resolved."""
    parts = ", ".join(f"{h}, exit_time_{h}m, long_return_{h}m, short_return_{h}m" for h in horizons)
    rows = labels.selectExpr("symbol", "decision_time", "entry_time", f"stack({len(horizons)}, {parts}) AS (horizon_minutes, exit_time, long_return, short_return)")
    return rows.where("exit_time IS NOT NULL")


def unresolved_mixtures(labels: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Rows with a horizon that is neither wholly resolved nor wholly null."""
    odd = F.lit(False)
    for h in horizons:
        known = [F.col(f"{c}_{h}m").isNotNull().cast("int") for c in ("exit_time", "long_return", "short_return", "action")]
        odd = odd | sum(known[1:], known[0]).isin(1, 2, 3)
    return labels.where(odd)
