"""The batch research pipeline: ticks to bars, features, labels, predictions, portfolio and acceptance, each stage a
written table that the next one reads, so scores never share a lazy plan with the labels they are judged by."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FEATURES_V1, HORIZONS, PAIRS, PortfolioConfig, ScreenGates, WalkForwardPlan
from ..operators import bars as B
from ..operators import evaluation as E
from ..operators import features as W
from ..operators import labels as L
from ..operators import models as M
from ..operators import portfolio as P
from ..operators import quality as Q
from ..operators import splits as S
from ..sources.sinks import read_table, require_compatible, write_table
from .records import content_id


@dataclass(frozen=True)
class ResearchConfig:
    plan: WalkForwardPlan
    bar_set: str = "quote-bars-v1"
    family: str = "ridge"
    threshold: float = 0.0
    gates: ScreenGates = field(default_factory=ScreenGates)
    portfolio: PortfolioConfig = field(default_factory=PortfolioConfig)


def validation_manifest(plan: WalkForwardPlan) -> dict:
    """The plan and its folds as a record with a content id."""
    names = ("fold_id", "index", "train_start", "train_end", "validation_start", "validation_end")
    body = {"plan": asdict(plan) | {"horizons": list(plan.horizons)}, "folds": [dict(zip(names, f, strict=True)) for f in S.fold_list(plan)]}
    return body | {"id": content_id(body)}


def run_id(config: ResearchConfig, source_id: str) -> str:
    return content_id({"config": json.loads(json.dumps(asdict(config))), "source": source_id})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_development(spark: SparkSession, ticks: DataFrame, root: str, config: ResearchConfig, source_id: str = "") -> dict:
    """Run or resume all stages below ``root``; returns the acceptance record.

    A stage whose table was committed is read and not run again; the run's folder is named by configuration and source, so
    another configuration never meets its tables.
    """
    base = f"{root.rstrip('/')}/{run_id(config, source_id)[:16]}"
    plan = config.plan

    def stage(name: str, make: Callable[[], DataFrame], contract: str, **provenance: str) -> DataFrame:
        path = f"{base}/{name}"
        if not _exists(spark, path):
            write_table(make(), path, contract, **provenance)
        return read_table(spark, path, contract, **provenance)

    audit = stage("audit", lambda: Q.tick_audit(ticks), "tick-audit-v1")
    if audit.where("critical_violations > 0").count():
        raise ValueError("the ticks have critical violations")
    v2 = config.bar_set == "quote-bars-v2"
    bars = stage("bars", lambda: (B.quote_bars_v2 if v2 else B.quote_bars_v1)(ticks), config.bar_set)
    Q.require_none(Q.bar_checks(bars).where("violations > 0"), "bars violate their contract")
    features = stage("features", lambda: (W.features_v2 if v2 else W.features_v1)(bars), "causal-v2" if v2 else "causal-v1", bars=config.bar_set)
    labels = stage("labels", lambda: L.executable_labels(bars), "executable-v1", bars=config.bar_set)
    require_compatible(features, labels)
    Q.require_none(S.misaligned(features, labels), "features and labels do not align")
    columns = tuple(c for c in features.columns if c not in ("symbol", "bar_end")) if v2 else FEATURES_V1

    def predict() -> DataFrame:
        cells = features.withColumnRenamed("bar_end", "decision_time").join(L.long_form(labels), ["symbol", "decision_time"])
        rows = S.fold_rows(M.resolved(cells), plan).withColumn("horizon_minutes", F.col("horizon_minutes").cast("int"))
        return M.predictions(M.walk_forward(rows, columns, config.family), config.threshold).drop("long_return", "short_return")

    predictions = stage("predictions", predict, "walk-forward-predictions", bars=config.bar_set)
    for found in (Q.prediction_checks(predictions, PAIRS, HORIZONS), Q.latency_checks(predictions), Q.leakage_check(predictions, plan.end, "exit_time")):
        Q.require_none(found.where("violations > 0"), "predictions violate their contract")
    metrics = stage("metrics", lambda: E.signal_metrics(predictions), "signal-metrics-v1")
    whole = predictions.withColumn("portfolio_id", F.lit("development"))
    ledger = stage("ledger", lambda: P.simulate_portfolios(whole, "ledger", config.portfolio), "ledger-v1")
    path = stage("equity", lambda: P.simulate_portfolios(whole, "equity", config.portfolio), "equity-v1")
    returns = stage("returns", lambda: P.simulate_portfolios(whole, "returns", config.portfolio), "period-returns-v1")
    summary = stage("summary", lambda: P.simulate_portfolios(whole, "summary", config.portfolio), "summary-v1")
    return acceptance(config, predictions, metrics, ledger, path, returns, summary, whole)


def acceptance(config: ResearchConfig, predictions: DataFrame, metrics: DataFrame, ledger: DataFrame, path: DataFrame, returns: DataFrame, summary: DataFrame, whole: DataFrame) -> dict:
    """The record of all gates: each a name, what was found, and whether it holds; accepted when all do.

    Reads small aggregates only; the replay gate simulates once more and compares all rows.
    """
    gates, folds = config.gates, S.fold_list(config.plan)
    model = {r["horizon_minutes"]: r for r in E.acceptance_model(predictions).collect()}
    pooled = {r["horizon_minutes"]: r for r in metrics.where("fold_id IS NULL").collect()}
    end = summary.first()
    totals = ledger.agg(F.count("*").alias("n"), F.coalesce(F.sum("pnl_usd"), F.lit(0.0)).alias("pnl")).first()
    worst = path.agg(F.max("drawdown")).first()[0] or 0.0
    volatility = returns.agg(F.coalesce(F.stddev_samp("portfolio_return"), F.lit(0.0))).first()[0] * config.portfolio.periods_per_year**0.5
    gain = (end["final_equity_usd"] if end else config.portfolio.initial_capital) - config.portfolio.initial_capital
    checks: list[tuple[str, object, bool]] = [("horizons", sorted(model), sorted(model) == sorted(config.plan.horizons))]
    for h, r in sorted(model.items()):
        checks += [
            (f"mean_bps_{h}", r["mean_bps"], r["mean_bps"] > gates.minimum_mean_bps),
            (f"positive_symbols_{h}", r["positive_symbols"], r["positive_symbols"] >= gates.minimum_positive_symbols),
            (f"positive_folds_{h}", r["positive_folds"], 2 * r["positive_folds"] > len(folds)),
            (f"minimum_trades_{h}", r["minimum_trades"], r["minimum_trades"] >= gates.minimum_trades),
            (f"observations_{h}", r["observations"], h in pooled and pooled[h]["observations"] == r["observations"]),
        ]
    checks += [
        ("drawdown", worst, worst < config.portfolio.drawdown_limit),
        ("not_halted", bool(end and end["halted"]), not (end and end["halted"])),
        ("positive_return", gain, gain > 0),
        ("volatility", volatility, volatility <= 2 * config.portfolio.target_volatility),
        ("ledger_reconciles", totals["pnl"] - gain, abs(totals["pnl"] - gain) <= 1e-6 * config.portfolio.initial_capital),
        ("replay", "rows of a second run", P.replay_differences(whole, ledger, config.portfolio).isEmpty()),
    ]
    body = {"checks": [{"name": n, "found": v, "passed": bool(ok)} for n, v, ok in checks], "accepted": all(ok for _, _, ok in checks), "trades": totals["n"]}
    return body | {"id": content_id(body)}
