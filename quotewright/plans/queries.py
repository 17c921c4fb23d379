"""Registered queries: each applies one operator to the ticks that the event table stands for, or to what is derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FEATURES_V1, HORIZONS, MINUTE, PAIRS, ScreenGates, WalkForwardPlan
from ..functions.calendar import expected_boundaries
from ..functions.expressions import elapsed_seconds_log1p, lot_weight
from ..operators import bars as B
from ..operators import coverage as C
from ..operators import crosspair as X
from ..operators import evaluation as E
from ..operators import features as W
from ..operators import labels as L
from ..operators import models as M
from ..operators import portfolio as P
from ..operators import quality as Q
from ..operators import splits as S
from ..sources import ticks as T

HOUR = 60 * MINUTE
START = T.EPOCH
#: Windows of two hours over the adapted ticks, and the calendar plan of three years of months.
PLAN = WalkForwardPlan(START, START + 6 * HOUR, START + 14 * HOUR, step=2 * HOUR)
MONTHLY = WalkForwardPlan(1_514_764_800_000_000, 1_640_995_200_000_000, 1_735_689_600_000_000)
SCORE_FEATURES = ("mid_return_1", "mid_return_3", "spread_bps", "quote_count_log1p", "staleness_seconds")
_STATS = {"mid_return_1": (0.0, 0.0, 0.002), "mid_return_3": (0.0, 0.0, 0.002), "spread_bps": (2.0, 2.0, 1.0), "quote_count_log1p": (2.0, 2.0, 0.5), "staleness_seconds": (20.0, 20.0, 20.0)}


def _model(h: int, side: int) -> M.FrozenModel:
    terms = {n: M.FrozenTerm(*_STATS[n], ((h * (7 - 2 * side) + i * (13 + 4 * side)) % 11 - 5) * 1e-4) for i, n in enumerate(SCORE_FEATURES)}
    return M.FrozenModel(h * 1e-6, terms)


MODELS = {h: (_model(h, 0), _model(h, 1)) for h in HORIZONS}
CUT_QUANTILE, SPREAD_LIMIT = 0.5, 1.0
GATES = ScreenGates(minimum_trades=5)
DIGITS = 8


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, small integers widened, so that results compare across engines."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c), DIGITS).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(c) for c in df.columns])


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return T.ticks_from_events(spark.read.parquet(f"{d}/events.parquet"))


def bars1(spark, d):
    return B.quote_bars_v1(ticks(spark, d))


def bars2(spark, d):
    return B.quote_bars_v2(ticks(spark, d))


def feats(spark, d):
    return W.features_v1(bars1(spark, d))


def labels(spark, d):
    return L.executable_labels(bars1(spark, d))


def aligned(spark, d):
    return S.align(feats(spark, d), labels(spark, d))


def cells(spark, d):
    """Resolved rows of features, one for each horizon."""
    on = ["symbol", "decision_time"]
    return feats(spark, d).withColumnRenamed("bar_end", "decision_time").join(L.long_form(labels(spark, d)), on)


def scores(spark, d):
    scored = M.frozen_scores(feats(spark, d).select("symbol", F.col("bar_end").alias("decision_time"), *SCORE_FEATURES, "spread_zscore_72"), MODELS)
    return scored.drop(*SCORE_FEATURES)


def scored_cells(spark, d):
    on = ["symbol", "decision_time", "horizon_minutes"]
    return scores(spark, d).join(L.long_form(labels(spark, d)), on)


def folded(spark, d):
    return S.fold_rows(scored_cells(spark, d), PLAN)


def preds(spark, d):
    return M.predictions(folded(spark, d).where("side = 'validation'")).drop("side", "fold_index")


def receipts(spark, d):
    """Receipt-time twin of the ticks: delays of 10 to 14 ms, made monotone, and a running ingest number."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    delayed = F.col("ts") + 10_000 + F.pmod("seq", F.lit(5)) * 1_000
    rows = ticks(spark, d).select("symbol", F.col("ts").alias("provider_ts"), F.max(delayed).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("received_at"), F.row_number().over(w).cast("long").alias("ingest_seq"), "bid", "ask", "mid", "spread")
    return rows.withColumn("seq", F.col("ingest_seq"))


def final_bars(spark, d):
    return B.prospective_bars(receipts(spark, d))


def statuses(spark, d):
    bars = bars1(spark, d)
    final = final_bars(spark, d).groupBy(F.col("bar_end").alias("boundary")).agg(F.max("feature_available_at").alias("feature_available_at"))
    return C.boundary_status(X.sections(bars), X.returns_at(W.features_v1(bars)), final)


def calendar_day(spark):
    return expected_boundaries(spark, START, START + 15 * HOUR)


def arms(spark, d):
    """Both arms' actions: the candidate adds the strength difference to the control's long score."""
    control = scores(spark, d).withColumn("arm", F.lit("control"))
    extra = X.cross_pair_features(feats(spark, d)).select("symbol", F.col("boundary").alias("decision_time"), (F.col("base_strength_1") - F.col("quote_strength_1")).alias("__x"))
    candidate = control.join(extra, ["symbol", "decision_time"]).withColumn("predicted_long_return", F.col("predicted_long_return") + F.lit(0.1) * F.col("__x")).drop("__x").withColumn("arm", F.lit("candidate"))
    both = control.unionByName(candidate)
    return both.select("arm", "symbol", "decision_time", "horizon_minutes", M.action(F.col("predicted_long_return"), F.col("predicted_short_return")).alias("action"))


def means(spark, d):
    return C.opportunity_means(calendar_day(spark), arms(spark, d), L.long_form(labels(spark, d)))


def trades(spark, d):
    return E.ledger(preds(spark, d))


def path(spark, d):
    return E.equity_path(trades(spark, d))


def segments(spark, d):
    """Hourly collection segments of each symbol, each bound to the one before by its id."""
    from pyspark.sql import Window

    t = ticks(spark, d)
    flags = [c.cast("int") for c in Q.price_flags().values()]
    hourly = t.groupBy("symbol", F.floor((F.col("ts") - START) / HOUR).alias("hour")).agg(F.count("*").alias("n_rows"), F.sum(sum(flags[1:], flags[0])).alias("critical_violations"))
    w = Window.partitionBy("symbol").orderBy("hour")
    rows = hourly.withColumn("sequence", (F.row_number().over(w) - 1).cast("long")).withColumn("segment_id", F.sha2(F.concat_ws("|", "symbol", "hour", "n_rows"), 256))
    return rows.withColumn("previous_segment_id", F.lag("segment_id").over(w))


def _paired(spark, d):
    cols = ["symbol", "horizon_minutes", "decision_time", "long_return", "short_return"]
    extra = X.cross_pair_features(feats(spark, d)).select("symbol", F.col("boundary").alias("decision_time"), "base_strength_1", "residual_1")
    return cells(spark, d).select(*cols, "mid_return_1").join(extra, ["symbol", "decision_time"])


def _cuts(spark, d):
    return M.conviction_cut(folded(spark, d).where("side = 'train'"), CUT_QUANTILE, 0.0, "symbol", "fold_id", "horizon_minutes")


def _walk(spark, d, family):
    rows = S.fold_rows(cells(spark, d).withColumn("horizon_minutes", F.col("horizon_minutes").cast("int")), PLAN)
    return M.predictions(M.walk_forward(rows, FEATURES_V1, family)).drop("long_return", "short_return")


def _simulated(spark, d):
    return P.simulate_portfolios(preds(spark, d).withColumn("portfolio_id", F.lit("all")), "ledger")


def _stream(spark, d):
    """The streaming operator over the receipt-time ticks, which arrive in three parts: open bars and watermarks are carried from one run to the next."""
    import uuid

    from ..streaming.bars import RECEIPT_SCHEMA, stream_bars

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='quotewright-stream-')}"
    base = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = receipts(spark, d).select(*[c.split()[0] for c in RECEIPT_SCHEMA.split(", ")])
    cuts = rows.approxQuantile("ingest_seq", [1 / 3, 2 / 3], 0.01)
    at = F.col("ingest_seq")
    for part in (at <= cuts[0], (at > cuts[0]) & (at <= cuts[1]), at > cuts[1]) if cuts else (F.lit(True),):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(RECEIPT_SCHEMA).parquet(f"{base}/in")
        job = stream_bars(source).writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/out")
        job.awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("invalidated_boundary")
    if failed := out.where("error IS NOT NULL").select("symbol", "error").limit(8).collect():
        raise ValueError(f"streams failed: {[tuple(r) for r in failed]}")
    return out.drop("error")


def _project(spark, d):
    return B.project_v1(bars2(spark, d))


def _elapsed(spark, d):
    return feats(spark, d).select("symbol", "bar_end", elapsed_seconds_log1p(F.col("elapsed_seconds")).alias("elapsed_seconds_log1p"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_ticks": lambda s, d: ticks(s, d),
    "scan_cutoff": lambda s, d: T.scan_range(ticks(s, d), end=START + 6 * HOUR),
    "scan_range": lambda s, d: T.scan_range(ticks(s, d), START + 2 * HOUR, START + 4 * HOUR),
    "ticks_canonical": lambda s, d: T.canonical_ticks(ticks(s, d)),
    "tick_quality": lambda s, d: Q.tick_quality(ticks(s, d)),
    "tick_order": lambda s, d: Q.tick_order(ticks(s, d)),
    "tick_duplicates": lambda s, d: Q.tick_duplicates(ticks(s, d)),
    "tick_audit": lambda s, d: Q.tick_audit(ticks(s, d)),
    "interval_check": lambda s, d: T.interval_check(ticks(s, d), START + HOUR, START + 10 * HOUR),
    "inventory_diff": lambda s, d: T.inventory_diff(s.read.parquet(f"{d}/orders.parquet").where("o_totalprice >= 250000").select(F.col("o_custkey").alias("custkey")).distinct(), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("custkey")), "custkey"),
    "quote_bars_v1": bars1,
    "quote_bars_v2": bars2,
    "project_v1": _project,
    "bar_check": lambda s, d: Q.bar_checks(bars1(s, d)),
    "label_bar_check": lambda s, d: Q.label_bar_checks(bars1(s, d)),
    "features_v1": feats,
    "elapsed_log1p": _elapsed,
    "features_v2": lambda s, d: W.features_v2(bars2(s, d)),
    "tail_context": lambda s, d: W.tail_context(bars1(s, d), START + 8 * HOUR).select("symbol", "bar_end", "mid_close", "quote_count"),
    "labels": labels,
    "align": lambda s, d: aligned(s, d).select("symbol", "decision_time", "mid_return_1", "spread_bps", "entry_time", "long_return_15m", "short_return_60m"),
    "misaligned_keys": lambda s, d: S.misaligned(feats(s, d), labels(s, d).where("entry_time IS NOT NULL")),
    "dev_slice": lambda s, d: S.development_slice(aligned(s, d), START + HOUR, START + 9 * HOUR).select("symbol", "decision_time", "mid_return_1", "action_30m"),
    "locked_rows": lambda s, d: S.locked_rows(labels(s, d), START + 9 * HOUR, START + 13 * HOUR, PLAN.purge).select("symbol", "decision_time", "entry_bid"),
    "folds": lambda s, d: S.folds(s, MONTHLY),
    "fold_rows": lambda s, d: S.fold_rows(labels(s, d).select("symbol", "decision_time"), PLAN),
    "inner_blocks": lambda s, d: S.inner_blocks(labels(s, d).select("symbol", "decision_time"), 4),
    "calib_rows": lambda s, d: labels(s, d).select("symbol", "decision_time", S.calibration_side(F.col("decision_time"), START + 5 * HOUR, START + 8 * HOUR, PLAN.purge).alias("side")).where("side IS NOT NULL"),
    "latency_check": lambda s, d: Q.latency_checks(preds(s, d)),
    "leakage_check": lambda s, d: Q.leakage_check(preds(s, d), START + 12 * HOUR, "decision_time", "exit_time"),
    "prediction_check": lambda s, d: Q.prediction_checks(preds(s, d), PAIRS, HORIZONS),
    "action_check": lambda s, d: preds(s, d).where(F.col("action") != M.action(F.col("predicted_long_return"), F.col("predicted_short_return"))).agg(F.count("*").alias("differences")),
    "train_stats": lambda s, d: M.train_stats(feats(s, d), SCORE_FEATURES, "symbol"),
    "null_rates": lambda s, d: M.null_rates(S.fold_rows(feats(s, d), PLAN, "bar_end"), ("mid_return_12", "realized_volatility_72", "spread_zscore_72", "elapsed_seconds")),
    "frozen_score": scores,
    "action_rule": lambda s, d: preds(s, d).select("symbol", "decision_time", "horizon_minutes", "fold_id", "action", "realized_return"),
    "calibrator": lambda s, d: M.calibrator(folded(s, d).where("side = 'train'"), "predicted_long_return", "long_return", "symbol", "fold_id", "horizon_minutes"),
    "ridge_1d": lambda s, d: M.ridge_closed_form(cells(s, d), "mid_return_1", "long_return", 1.0, "symbol", "horizon_minutes"),
    "conviction_cut": _cuts,
    "gated_mean": lambda s, d: M.gated_mean(folded(s, d).where("side = 'validation'"), _cuts(s, d), 0.0, SPREAD_LIMIT, "symbol", "fold_id", "horizon_minutes"),
    "signal_metrics": lambda s, d: E.signal_metrics(preds(s, d)),
    "locked_outcomes": lambda s, d: E.locked_outcomes(M.predictions(scores(s, d).withColumns({"long_return": F.lit(0.0), "short_return": F.lit(0.0)})), L.long_form(labels(s, d))),
    "locked_metrics": lambda s, d: E.signal_metrics(E.locked_outcomes(M.predictions(scores(s, d).withColumns({"long_return": F.lit(0.0), "short_return": F.lit(0.0)})), L.long_form(labels(s, d))), "symbol"),
    "score_reconcile": lambda s, d: E.score_reconcile(M.predictions(scores(s, d).withColumns({"long_return": F.lit(0.0), "short_return": F.lit(0.0)})), preds(s, d)),
    "screen_gates": lambda s, d: E.screen_gates(preds(s, d), GATES),
    "acceptance_model": lambda s, d: E.acceptance_model(preds(s, d)),
    "acceptance_portfolio": lambda s, d: E.acceptance_portfolio(path(s, d)),
    "attribution": lambda s, d: E.attribution(trades(s, d)),
    "portfolio_report": lambda s, d: E.portfolio_report(path(s, d), E.period_returns(trades(s, d))),
    "drawdown": path,
    "rolling_vol": lambda s, d: E.rolling_volatility(E.period_returns(trades(s, d)), 24, 12),
    "lot_weight": lambda s, d: preds(s, d).select("symbol", "decision_time", "horizon_minutes", lot_weight(F.col("horizon_minutes")).alias("weight")),
    "event_schedule": lambda s, d: trades(s, d).select(F.col("entry_time").alias("event_time"), F.lit(0).alias("kind"), "symbol", "horizon_minutes", "decision_time").unionByName(trades(s, d).select(F.col("exit_time").alias("event_time"), F.lit(1).alias("kind"), "symbol", "horizon_minutes", "decision_time")),
    "calendar": lambda s, d: expected_boundaries(s, START, START + 7 * 24 * HOUR),
    "calendar_join": lambda s, d: calendar_day(s).join(bars1(s, d).select(F.col("bar_end").alias("boundary"), "symbol", "mid_close"), "boundary", "left"),
    "sync_sections": lambda s, d: X.sections(bars1(s, d)),
    "factor_solution": lambda s, d: X.factor_solution(feats(s, d)),
    "cross_pair": lambda s, d: X.cross_pair_features(feats(s, d)),
    "cross_pair_hist": lambda s, d: calendar_day(s).join(X.cross_pair_features(feats(s, d)), "boundary", "left").select("boundary", "symbol", "residual_1", "residual_sum_3", "residual_dispersion_mean_12"),
    "boundary_status": statuses,
    "opportunities": lambda s, d: C.opportunities(statuses(s, d)),
    "ledger_check": lambda s, d: C.ledger_check(C.opportunities(statuses(s, d))),
    "coverage": lambda s, d: C.coverage(C.against_calendar(calendar_day(s), statuses(s, d))),
    "anti_unexpected": lambda s, d: statuses(s, d).select("boundary").join(expected_boundaries(s, START, START + 10 * HOUR), "boundary", "left_anti"),
    "paired_training": _paired,
    "opportunity_means": means,
    "arm_delta": lambda s, d: C.arm_delta(means(s, d)),
    "receipt_audit": lambda s, d: Q.receipt_audit(receipts(s, d)),
    "prospective_bars": final_bars,
    "prospective_bar_check": lambda s, d: Q.prospective_bar_checks(final_bars(s, d)),
    "custody_chain": lambda s, d: E.custody_chain(segments(s, d)),
    "stream_bars": _stream,
    "ridge_walk_forward": lambda s, d: _walk(s, d, "ridge"),
    "gbt_walk_forward": lambda s, d: _walk(s, d, "trees"),
    "portfolio_sim": _simulated,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda s, d, f=f: tidy(f(s, d))) for k, f in QUERIES.items()}
