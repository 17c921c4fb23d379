"""Metrics, gates and reports over predictions, ledgers and equity paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import ScreenGates
from ..functions.expressions import bucket, lot_weight


def _metrics() -> list[Column]:
    traded = F.col("action") != "flat"
    return [
        F.count("*").alias("observations"),
        F.count_if(traded).alias("trades"),
        (F.count_if(traded) / F.count("*")).alias("trade_rate"),
        (F.avg("realized_return") * 10_000).alias("mean_bps"),
        (F.stddev_pop("realized_return") * 10_000).alias("stddev_bps"),
        F.when(F.count_if(traded) > 0, F.count_if(traded & (F.col("realized_return") > 0)) / F.count_if(traded)).alias("hit_rate"),
    ]


def signal_metrics(predictions: DataFrame, by: str = "fold_id") -> DataFrame:
    """Metrics by horizon and by (``by``, horizon), in one pass; null ``by`` marks the pooled rows."""
    return predictions.groupingSets([["horizon_minutes"], [by, "horizon_minutes"]], by, "horizon_minutes").agg(*_metrics())


def ledger(predictions: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Trades with the profit of unlevered lots."""
    weight = lot_weight(F.col("horizon_minutes"))
    return predictions.where("action <> 'flat'").withColumn("pnl_usd", F.col("realized_return") * weight * capital)


def attribution(trades: DataFrame) -> DataFrame:
    """Trades, profit and win rate by symbol, by horizon and by fold."""
    sets = trades.groupingSets([["symbol"], ["horizon_minutes"], ["fold_id"]], "symbol", "horizon_minutes", "fold_id")
    return sets.agg(F.count("*").alias("trades"), F.sum("pnl_usd").alias("pnl_usd"), (F.count_if(F.col("pnl_usd") > 0) / F.count("*")).alias("win_rate"))


def period_returns(trades: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Profit of each five-minute interval with exits, over the capital."""
    return trades.groupBy(bucket("exit_time").alias("period")).agg((F.sum("pnl_usd") / capital).alias("portfolio_return"))


def equity_path(trades: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Equity, running peak and drawdown after the trades of each exit time.

    The path is one ordered sequence, so it is computed after trades are aggregated to exit times, which are no more than
    the calendar has.
    """
    steps = trades.groupBy(F.col("exit_time").alias("event_time")).agg(F.sum("pnl_usd").alias("pnl_usd"))
    w = Window.orderBy("event_time").rowsBetween(Window.unboundedPreceding, 0)
    path = steps.withColumn("equity_usd", F.lit(capital) + F.sum("pnl_usd").over(w))
    path = path.withColumn("running_peak_usd", F.greatest(F.max("equity_usd").over(w), F.lit(capital)))
    return path.withColumn("drawdown", 1 - F.col("equity_usd") / F.col("running_peak_usd"))


def rolling_volatility(periods: DataFrame, lookback: int = 5_760, minimum: int = 288, per_year: float = 72_576.0) -> DataFrame:
    """Annualised sample deviation of the last ``lookback`` period returns; null below ``minimum`` of them."""
    w = Window.orderBy("period").rowsBetween(1 - lookback, 0)
    value = F.when(F.count("portfolio_return").over(w) >= minimum, F.stddev_samp("portfolio_return").over(w) * F.sqrt(F.lit(per_year)))
    return periods.select("period", value.alias("annual_volatility"))


def portfolio_report(path: DataFrame, periods: DataFrame, capital: float = 100_000.0, per_year: float = 72_576.0, limit: float = 0.10) -> DataFrame:
    """One row: final equity, return, drawdown, whether the limit was reached, and volatility."""
    a = path.agg(F.count("*").alias("events"), F.max_by("equity_usd", "event_time").alias("final_equity_usd"), F.max("drawdown").alias("maximum_drawdown"), F.coalesce(F.bool_or(F.col("drawdown") >= limit), F.lit(False)).alias("halt_triggered"))
    b = periods.agg(F.count("*").alias("periods"), F.coalesce(F.stddev_samp("portfolio_return") * F.sqrt(F.lit(per_year)), F.lit(0.0)).alias("annual_volatility"))
    return a.crossJoin(b).withColumn("total_return", F.col("final_equity_usd") / capital - 1)


def _cells(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_if(F.col("action") != "flat").alias("trades"), F.sum("realized_return").alias("total"))


def screen_gates(predictions: DataFrame, gates: ScreenGates) -> DataFrame:
    """Per horizon: pooled mean, symbols with a positive mean, least trades of a cell, and which gates hold."""
    cells = _cells(predictions, "symbol", "horizon_minutes")
    out = cells.groupBy("horizon_minutes").agg(
        (F.sum("total") / F.sum("observations") * 10_000).alias("mean_bps"), F.count_if(F.col("total") / F.col("observations") > 0).alias("positive_symbols"), F.min("trades").alias("minimum_trades")
    )
    return out.withColumns({
        "mean_gate": F.col("mean_bps") > gates.minimum_mean_bps,
        "symbol_gate": F.col("positive_symbols") >= gates.minimum_positive_symbols,
        "trade_gate": F.col("minimum_trades") >= gates.minimum_trades,
    })


def acceptance_model(predictions: DataFrame) -> DataFrame:
    """Per horizon: observation-weighted mean, positive folds and symbols, cells, and least trades of a cell."""
    cells = _cells(predictions, "symbol", "fold_id", "horizon_minutes")
    pooled = cells.groupBy("horizon_minutes").agg(F.count("*").alias("cells"), F.sum("observations").alias("observations"), (F.sum("total") / F.sum("observations") * 10_000).alias("mean_bps"), F.min("trades").alias("minimum_trades"))
    for key, name in (("fold_id", "positive_folds"), ("symbol", "positive_symbols")):
        side = cells.groupBy(key, "horizon_minutes").agg(F.sum("total").alias("t")).groupBy("horizon_minutes").agg(F.count_if(F.expr("t > 0")).alias(name))
        pooled = pooled.join(side, "horizon_minutes")
    return pooled


def acceptance_portfolio(path: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Re-aggregation of an equity path: total profit and the greatest errors of its equity, peak and drawdown columns."""
    w = Window.orderBy("event_time").rowsBetween(Window.unboundedPreceding, 0)
    rows = path.withColumn("__equity", F.lit(capital) + F.sum("pnl_usd").over(w)).withColumn("__peak", F.greatest(F.max("equity_usd").over(w), F.lit(capital)))
    return rows.agg(
        F.sum("pnl_usd").alias("total_pnl"),
        F.max(F.abs(F.col("__equity") - F.col("equity_usd"))).alias("equity_error"),
        F.max(F.abs(F.col("__peak") - F.col("running_peak_usd"))).alias("peak_error"),
        F.max(F.abs(1 - F.col("equity_usd") / F.col("__peak") - F.col("drawdown"))).alias("drawdown_error"),
    )


def locked_outcomes(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Frozen scores with outcomes; a decision without one is flat with zero return and marked unavailable."""
    on = ["symbol", "decision_time", "horizon_minutes"]
    joined = scores.select(*on, "predicted_long_return", "predicted_short_return", "action").join(labels.select(*on, "entry_time", "exit_time", "long_return", "short_return"), on, "left")
    known = F.col("exit_time").isNotNull()
    act = F.when(known, F.col("action")).otherwise("flat")
    value = F.when(known & (F.col("action") == "long"), F.col("long_return")).when(known & (F.col("action") == "short"), F.col("short_return")).otherwise(F.lit(0.0))
    return joined.select(*on, "predicted_long_return", "predicted_short_return", act.alias("action"), "entry_time", "exit_time", known.alias("execution_available"), value.alias("realized_return"))


def score_reconcile(scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: keys on either side alone, and whether all scores and actions of common keys agree."""
    on = ["symbol", "decision_time", "horizon_minutes"]
    cols = ["predicted_long_return", "predicted_short_return", "action"]
    a = scores.select(*on, *cols, F.lit(True).alias("__a"))
    b = predictions.select(*on, *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__b"))
    same = F.lit(True)
    for c in cols:
        same = same & (F.col(c) == F.col(f"__{c}"))
    j = a.join(b, on, "full_outer")
    return j.agg(F.count_if(F.col("__b").isNull()).alias("only_scores"), F.count_if(F.col("__a").isNull()).alias("only_predictions"), F.coalesce(F.every(F.when(F.col("__a") & F.col("__b"), same)), F.lit(True)).alias("agree"))


def custody_chain(segments: DataFrame) -> DataFrame:
    """Per symbol: segments, rows, critical violations, and breaks of numbering or of predecessor hashes."""
    w = Window.partitionBy("symbol").orderBy("sequence")
    before = F.lag("segment_id").over(w)
    broken = (~F.col("previous_segment_id").eqNullSafe(before)) | (F.col("sequence") != F.row_number().over(w) - 1)
    return segments.withColumn("__broken", broken).groupBy("symbol").agg(F.count("*").alias("segments"), F.sum("n_rows").alias("n_rows"), F.sum("critical_violations").alias("critical_violations"), F.count_if("__broken").alias("breaks"), F.max_by("segment_id", "sequence").alias("terminal_segment_id"))
