"""Quote bars: half-open five-minute intervals of ticks; an interval without ticks has no bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import BAR, COMPUTE_ALLOWANCE, PRICES
from ..functions.expressions import bucket, imbalance

V1_COLUMNS = (
    "symbol", "bar_start", "bar_end", "first_tick", "last_tick",
    *[f"{p}_{k}" for p in PRICES for k in ("open", "high", "low", "close")], "spread_mean", "quote_count", "staleness_ns",
)
UPDATES = ("bid_update_count", "ask_update_count", "mid_uptick_count", "mid_downtick_count", "spread_widening_count", "spread_narrowing_count")


def _base() -> list[Column]:
    """Aggregates of v1: first and last rows travel as one struct each, so partial aggregation keeps two rows a bar."""
    row = F.struct("ts", "seq", *PRICES)
    prices = [f(p).alias(f"{p}_{k}") for p in PRICES for k, f in (("high", F.max), ("low", F.min))]
    return [F.min(row).alias("__first"), F.max(row).alias("__last"), *prices, F.avg("spread").alias("spread_mean"), F.count("*").alias("quote_count")]


def _v1(grouped: DataFrame, *more: Column | str) -> DataFrame:
    out = grouped.withColumns(
        {"bar_end": F.col("bar_start") + BAR, "first_tick": F.col("__first.ts"), "last_tick": F.col("__last.ts")} | {f"{p}_open": F.col(f"__first.{p}") for p in PRICES} | {f"{p}_close": F.col(f"__last.{p}") for p in PRICES}
    )
    return out.withColumn("staleness_ns", (F.col("bar_end") - F.col("last_tick")) * 1000).select(*V1_COLUMNS, *more)


def quote_bars_v1(ticks: DataFrame) -> DataFrame:
    """OHLC of bid, ask, mid and spread, mean spread, tick count and staleness for each symbol and interval."""
    return _v1(ticks.withColumn("bar_start", bucket("ts")).groupBy("symbol", "bar_start").agg(*_base()))


def quote_bars_v2(ticks: DataFrame) -> DataFrame:
    """v1 and counts of changes between neighbouring ticks of the same bar; one shuffle, on (symbol, interval)."""
    w = Window.partitionBy("symbol", "bar_start").orderBy("ts", "seq")
    rows = ticks.withColumn("bar_start", bucket("ts"))
    rows = rows.select("*", *[F.lag(c).over(w).alias(f"__{c}") for c in ("ts", *PRICES)])
    gap = (F.col("ts") - F.col("__ts")).cast("double") / 1_000_000
    steps = [
        F.count_if(F.col("bid") != F.col("__bid")),
        F.count_if(F.col("ask") != F.col("__ask")),
        F.count_if(F.col("mid") > F.col("__mid")),
        F.count_if(F.col("mid") < F.col("__mid")),
        F.count_if(F.col("spread") > F.col("__spread")),
        F.count_if(F.col("spread") < F.col("__spread")),
    ]
    grouped = rows.groupBy("symbol", "bar_start").agg(*_base(), *[s.alias(k) for s, k in zip(steps, UPDATES, strict=True)], F.count("__ts").alias("__n"), F.sum(gap).alias("__sum"), F.sum(gap * gap).alias("__squares"))
    mean = F.col("__sum") / F.col("__n")
    spread = F.when(F.col("__n") > 0, F.sqrt(F.greatest(F.col("__squares") / F.col("__n") - mean * mean, F.lit(0.0)))).otherwise(F.lit(0.0))
    pairs = {"bid_ask_update_imbalance": UPDATES[:2], "mid_tick_imbalance": UPDATES[2:4], "spread_change_imbalance": UPDATES[4:]}
    return _v1(grouped, *UPDATES, *[imbalance(F.col(a), F.col(b)).alias(k) for k, (a, b) in pairs.items()], spread.alias("interarrival_dispersion_seconds"))


def project_v1(bars: DataFrame) -> DataFrame:
    return bars.select(*V1_COLUMNS)


def prospective_bars(receipts: DataFrame) -> DataFrame:
    """Watermark-final bars of receipt-time ticks (provider_ts, received_at, ingest_seq, prices), as the streaming operator emits them.

    A bar is final when the symbol's next tick of a later interval is received; a last bar without such a tick is dropped.
    Late input is for the audit to reject: these are the bars of a stream in order.
    """
    ticks = receipts.withColumns({"ts": F.col("provider_ts"), "seq": F.col("ingest_seq"), "bar_start": bucket("provider_ts")})
    grouped = ticks.groupBy("symbol", "bar_start").agg(
        *_base(), F.min("received_at").alias("first_received_at"), F.max("received_at").alias("last_received_at"), F.min("ingest_seq").alias("first_ingest_seq"), F.max("ingest_seq").alias("last_ingest_seq"),
        F.min(F.struct("ingest_seq", "provider_ts", "received_at")).alias("__head"),
    )
    after = F.lead("__head").over(Window.partitionBy("symbol").orderBy("bar_start"))
    final = grouped.withColumn("__mark", after).where("__mark IS NOT NULL")
    return _v1(
        final,
        "first_received_at",
        "last_received_at",
        F.col("__mark.provider_ts").alias("watermark_provider_ts"),
        F.col("__mark.ingest_seq").alias("watermark_ingest_seq"),
        F.col("__mark.received_at").alias("bar_finalized_at"),
        (F.col("__mark.received_at") + COMPUTE_ALLOWANCE).alias("feature_available_at"),
        "first_ingest_seq",
        "last_ingest_seq",
    )
