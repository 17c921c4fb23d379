"""Data quality: counters over raw ticks and receipt-time ticks, and violation filters over derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import BAR, COMPUTE_ALLOWANCE, LATENCY, MAX_CLOCK_LEAD, MINUTE, PRICE_TOLERANCE, PRICES
from ..functions.expressions import action, finite, holds, price_check


#: Rows of one stretch of physical order, within which each row meets the one before it.
STRETCH = 1_000_000


def with_previous(ticks: DataFrame, *columns: str) -> DataFrame:
    """``ticks`` with ``__before_<column>``: the value of the symbol's row before, in physical order ``seq``; null for the first.

    Rows are ordered within stretches of ``seq`` and the last row of each stretch is carried to the next, so a symbol's ticks are not
    sorted in one task; ordering stretches takes one row for each.
    """
    cut = ticks.withColumn("__stretch", F.floor(F.col("seq") / STRETCH))
    last = cut.groupBy("symbol", "__stretch").agg(F.max_by(F.struct(*columns), "seq").alias("__last"))
    carried = last.select("symbol", "__stretch", F.lag("__last").over(Window.partitionBy("symbol").orderBy("__stretch")).alias("__carried"))
    w = Window.partitionBy("symbol", "__stretch").orderBy("seq")
    rows = cut.withColumn("__first", F.row_number().over(w) == 1).withColumns({f"__lag_{c}": F.lag(c).over(w) for c in columns}).join(carried, ["symbol", "__stretch"])
    before = {f"__before_{c}": F.when(F.col("__first"), F.col(f"__carried.{c}")).otherwise(F.col(f"__lag_{c}")) for c in columns}
    return rows.withColumns(before).drop("__stretch", "__first", "__carried", *[f"__lag_{c}" for c in columns])


def price_flags() -> dict[str, Column]:
    bid, ask, mid, spread = (F.col(c) for c in PRICES)
    return {
        "non_positive_bid": price_check(bid <= 0, bid),
        "non_positive_ask": price_check(ask <= 0, ask),
        "crossed_quotes": price_check(bid > ask, bid, ask),
        "inconsistent_mid": price_check(F.abs(mid - (bid + ask) / 2) > PRICE_TOLERANCE, mid, bid, ask),
        "inconsistent_spread": price_check(F.abs(spread - (ask - bid)) > PRICE_TOLERANCE, spread, bid, ask),
    }


def _null_values(*names: str) -> Column:
    return sum((F.count_if(F.col(c).isNull()) for c in names[1:]), F.count_if(F.col(names[0]).isNull()))


def tick_quality(ticks: DataFrame) -> DataFrame:
    """Counters that look at one row at a time, for each symbol."""
    odd = sum((F.count_if(F.col(c).isNotNull() & ~finite(F.col(c))) for c in PRICES[1:]), F.count_if(F.col("bid").isNotNull() & ~finite(F.col("bid"))))
    return ticks.groupBy("symbol").agg(F.count("*").alias("n_rows"), _null_values("ts", *PRICES).alias("null_values"), odd.alias("non_finite_values"), *[F.count_if(c).alias(k) for k, c in price_flags().items()])


def tick_order(ticks: DataFrame) -> DataFrame:
    """Rows that step back in time in physical order, and the largest forward gap (microseconds)."""
    return with_previous(ticks, "ts").select("symbol", (F.col("ts") - F.col("__before_ts")).alias("gap")).groupBy("symbol").agg(F.count_if(F.expr("gap < 0")).alias("out_of_order"), F.coalesce(F.max(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0)).alias("max_gap"))


def tick_duplicates(ticks: DataFrame) -> DataFrame:
    """Rows beyond the first of each group that is equal in time and all prices."""
    groups = ticks.groupBy("symbol", "ts", *PRICES).agg(F.count("*").alias("n"))
    return groups.groupBy("symbol").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def tick_audit(ticks: DataFrame) -> DataFrame:
    """All counters of a symbol in one row, and the sum of those that are critical (all but the gap)."""
    joined = tick_quality(ticks).join(tick_order(ticks), "symbol").join(tick_duplicates(ticks), "symbol")
    critical = [c for c in joined.columns if c not in ("symbol", "n_rows", "max_gap")]
    return joined.withColumn("critical_violations", sum((F.col(c) for c in critical[1:]), F.col(critical[0])))


def receipt_audit(ticks: DataFrame) -> DataFrame:
    """Counters for receipt-time ticks (provider_ts, received_at, ingest_seq, prices) of each symbol, in physical order ``seq``.

    A symbol with any null gets its rows and nulls counted and nothing else.
    """
    needed = ("provider_ts", "received_at", "ingest_seq", *PRICES)
    rows = with_previous(ticks, "provider_ts", "received_at", "ingest_seq")
    odd = sum((F.count_if(~finite(F.col(c))) for c in PRICES[1:]), F.count_if(~finite(F.col("bid"))))
    checks = {
        "non_finite_values": odd,
        **{k: F.count_if(c) for k, c in price_flags().items()},
        "provider_out_of_order": F.count_if(F.col("provider_ts") < F.col("__before_provider_ts")),
        "receipt_out_of_order": F.count_if(F.col("received_at") < F.col("__before_received_at")),
        "sequence_not_increasing": F.count_if(F.col("ingest_seq") <= F.col("__before_ingest_seq")),
        "clock_lead_violations": F.count_if(F.col("provider_ts") - F.col("received_at") > MAX_CLOCK_LEAD),
        "max_delivery_latency": F.greatest(F.coalesce(F.max(F.col("received_at") - F.col("provider_ts")), F.lit(0)), F.lit(0)),
    }
    counted = rows.groupBy("symbol").agg(F.count("*").alias("n_rows"), _null_values(*needed).alias("null_values"), *[c.alias(k) for k, c in checks.items()])
    return counted.select("symbol", "n_rows", "null_values", *[F.when(F.col("null_values") == 0, F.col(k)).otherwise(F.lit(0)).cast("long").alias(k) for k in checks])


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): how many rows fulfil each violation predicate; one pass."""
    counts = df.agg(*[F.count_if(holds(c)).alias(k) for k, c in checks.items()])
    names = ", ".join(f"'{k}', `{k}`" for k in checks)
    return counts.selectExpr(f"stack({len(checks)}, {names}) AS (check, violations)")


def require_none(df: DataFrame, message: str) -> None:
    """Raise where a violation filter leaves a row; reads no more than one."""
    if not df.isEmpty():
        raise ValueError(message)


def bar_checks(bars: DataFrame) -> DataFrame:
    """Bar sanity for features."""
    before = F.lag("bar_end").over(Window.partitionBy("symbol").orderBy("bar_start"))
    rows = bars.withColumn("__before", before)
    close, high, low, spread = (F.col(c) for c in ("mid_close", "mid_high", "mid_low", "spread_close"))
    return violations(rows, {
        "span": F.col("bar_end") - F.col("bar_start") != BAR,
        "grid": F.pmod("bar_end", F.lit(BAR)) != 0,
        "order": F.col("bar_end") <= F.col("__before"),
        "finite": ~(finite(close) & finite(high) & finite(low) & finite(spread)),
        "prices": price_check((close <= 0) | (low > close) | (close > high) | (spread < 0), close, high, low, spread),
        "activity": (F.col("quote_count") < 0) | (F.col("staleness_ns") < 0),
    })


def label_bar_checks(bars: DataFrame) -> DataFrame:
    """Bar sanity for labels."""
    w = Window.partitionBy("symbol").orderBy("bar_start")
    rows = bars.withColumn("__tick", F.lag("first_tick").over(w)).withColumn("__end", F.lag("bar_end").over(w))
    bid, ask = F.col("bid_open"), F.col("ask_open")
    return violations(rows, {
        "span": F.col("bar_end") - F.col("bar_start") != BAR,
        "first_tick_inside": (F.col("first_tick") < F.col("bar_start")) | (F.col("first_tick") >= F.col("bar_end")),
        "tick_order": F.col("first_tick") <= F.col("__tick"),
        "bar_order": F.col("bar_end") <= F.col("__end"),
        "finite": ~(finite(bid) & finite(ask)),
        "prices": price_check((bid <= 0) | (ask < bid), bid, ask),
    })


def prospective_bar_checks(bars: DataFrame) -> DataFrame:
    """Relations between provider, receipt and watermark columns of watermark-final bars."""
    c = F.col
    return violations(bars, {
        "span": (c("bar_end") - c("bar_start") != BAR) | (F.pmod("bar_end", F.lit(BAR)) != 0),
        "inside": ~((c("bar_start") <= c("first_tick")) & (c("first_tick") <= c("last_tick")) & (c("last_tick") < c("bar_end"))),
        "receipt": ~((c("first_received_at") <= c("last_received_at")) & (c("last_received_at") <= c("bar_finalized_at"))),
        "watermark_time": c("watermark_provider_ts") < c("bar_end"),
        "available": c("feature_available_at") < c("bar_end"),
        "allowance": c("feature_available_at") - c("bar_finalized_at") != COMPUTE_ALLOWANCE,
        "sequence": c("first_ingest_seq") > c("last_ingest_seq"),
        "watermark_sequence": c("watermark_ingest_seq") <= c("last_ingest_seq"),
        "empty": c("quote_count") <= 0,
        "staleness": c("staleness_ns") != (c("bar_end") - c("last_tick")) * 1000,
    })


def latency_checks(predictions: DataFrame) -> DataFrame:
    """Entries and exits outside their due windows."""
    d, entry, exit_, h = F.col("decision_time"), F.col("entry_time"), F.col("exit_time"), F.col("horizon_minutes").cast("long") * MINUTE
    return violations(predictions, {"entry": ~entry.between(d, d + LATENCY), "exit": ~exit_.between(d + h, d + h + LATENCY), "order": entry >= exit_})


def leakage_check(rows: DataFrame, cutoff: int, *columns: str) -> DataFrame:
    """(check, violations): rows with a time at or beyond the cutoff."""
    return violations(rows, {c: F.col(c) >= cutoff for c in columns})


def prediction_checks(predictions: DataFrame, symbols: tuple[str, ...], horizons: tuple[int, ...]) -> DataFrame:
    """Contract of predictions: universe, horizons, finite numbers, flat means zero, unique keys, reproducible action."""
    keys = predictions.groupBy("symbol", "decision_time", "horizon_minutes").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("violations"))
    numbers = [F.col(c) for c in ("predicted_long_return", "predicted_short_return", "realized_return")]
    ok = finite(numbers[0]) & finite(numbers[1]) & finite(numbers[2])
    rows = violations(predictions, {
        "symbol": ~F.col("symbol").isin(*symbols),
        "horizon": ~F.col("horizon_minutes").isin(*horizons),
        "finite": ~ok,
        "flat_is_zero": (F.col("action") == "flat") & (F.col("realized_return") != 0),
        "action": F.col("action") != action(numbers[0], numbers[1]),
    })
    return rows.unionByName(keys.select(F.lit("unique_key").alias("check"), F.col("violations").cast("long").alias("violations")))
