"""Per-symbol models: ridge, boosted trees, calibration, frozen scoring by column arithmetic, and conviction gates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import action, finite, realized

KEYS = ("symbol", "fold_id", "horizon_minutes")
SCORED = "symbol string, fold_id string, horizon_minutes int, decision_time long, entry_time long, exit_time long, predicted_long_return double, predicted_short_return double, long_return double, short_return double"


@dataclass(frozen=True)
class FrozenTerm:
    median: float
    mean: float
    scale: float
    coefficient: float


@dataclass(frozen=True)
class FrozenModel:
    """A linear model as plain numbers: it is applied as one column expression, without Python on the executors."""

    intercept: float
    terms: dict[str, FrozenTerm] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if any(not t.scale > 0 for t in self.terms.values()):
            raise ValueError("scales must be positive")

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for name, t in self.terms.items():
            out = out + F.lit(t.coefficient) * ((F.coalesce(F.col(name), F.lit(t.median)) - t.mean) / t.scale)
        return out


def frozen_scores(rows: DataFrame, models: dict[int, tuple[FrozenModel, FrozenModel]]) -> DataFrame:
    """One row for each input row and horizon, with the long and the short model's prediction."""
    cells = [F.struct(F.lit(h).alias("horizon_minutes"), long.column().alias("predicted_long_return"), short.column().alias("predicted_short_return")) for h, (long, short) in models.items()]
    rest = [c for c in rows.columns if c != "__cell"]
    return rows.select(*rest, F.explode(F.array(*cells)).alias("__cell")).select(*rest, "__cell.*")


def predictions(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds action and realized return to rows with predictions and resolved returns."""
    act = action(F.col("predicted_long_return"), F.col("predicted_short_return"), threshold)
    return scored.withColumn("action", act).withColumn("realized_return", realized(F.col("action"), F.col("long_return"), F.col("short_return")))


def resolved(rows: DataFrame) -> DataFrame:
    return rows.where(finite(F.col("long_return")) & finite(F.col("short_return")))


def train_stats(rows: DataFrame, columns: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, feature, median, mean, scale) after imputing the median; the median is exact and interpolated."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    long = rows.selectExpr(*keys, f"stack({len(columns)}, {pairs}) AS (feature, x)")
    medians = long.groupBy(*keys, "feature").agg(F.coalesce(F.median("x"), F.lit(0.0)).alias("median"))
    filled = long.join(medians, [*keys, "feature"]).withColumn("x", F.coalesce("x", "median"))
    return filled.groupBy(*keys, "feature").agg(F.first("median").alias("median"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))


def ridge_closed_form(rows: DataFrame, x: str, y: str, alpha: float, *keys: str) -> DataFrame:
    """(keys, slope, intercept, n) of ridge on one standardised feature, from aggregates alone."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy"))
    slope = F.when(F.col("vx") > 0, F.col("n") * F.col("cxy") / F.sqrt("vx") / (F.col("n") + F.lit(float(alpha)))).otherwise(F.lit(0.0))
    return a.select(*keys, "n", slope.alias("slope"), F.col("my").alias("intercept"))


def calibrator(rows: DataFrame, score: str, outcome: str, *keys: str) -> DataFrame:
    """(keys, n, slope, intercept) of a least-squares line whose slope is not negative; 0 where scores do not vary."""
    a = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(score).alias("mx"), F.avg(outcome).alias("my"), F.var_pop(score).alias("vx"), F.covar_pop(score, outcome).alias("cxy"))
    slope = F.when(F.col("vx") > 0, F.greatest(F.col("cxy") / F.col("vx"), F.lit(0.0))).otherwise(F.lit(0.0))
    return a.withColumn("slope", slope).select(*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def conviction_cut(rows: DataFrame, quantile: float, floor: float, *keys: str) -> DataFrame:
    """(keys, threshold): the interpolated quantile of scores above the floor; infinite where there are none."""
    score = F.greatest("predicted_long_return", "predicted_short_return")
    return rows.groupBy(*keys).agg(F.coalesce(F.percentile(F.when(score > floor, score), 1.0 - quantile), F.lit(float("inf"))).alias("threshold"))


def gated_mean(rows: DataFrame, cuts: DataFrame, floor: float, spread_zscore_maximum: float | None, *keys: str) -> DataFrame:
    """(keys, observations, admitted, mean_bps) of decisions that pass the gate; the others count as zero."""
    score = F.greatest("predicted_long_return", "predicted_short_return")
    gate = (score > floor) & (score >= F.col("threshold"))
    if spread_zscore_maximum is not None:
        gate = gate & finite(F.col("spread_zscore_72")) & (F.col("spread_zscore_72") <= spread_zscore_maximum)
    taken = F.when(F.col("predicted_long_return") > F.col("predicted_short_return"), F.col("long_return")).otherwise(F.col("short_return"))
    joined = rows.join(cuts, list(keys))
    return joined.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_if(gate).alias("admitted"), (F.avg(F.when(gate, taken).otherwise(F.lit(0.0))) * 10_000).alias("mean_bps"))


def null_rates(folded: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(fold_id, side, feature, null_rate)."""
    rates = folded.groupBy("fold_id", "side").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return rates.selectExpr("fold_id", "side", f"stack({len(columns)}, {pairs}) AS (feature, null_rate)")


# Fits, each in one group of (symbol, fold, horizon): bars are few, however many ticks they hold.


def _prepared(train: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median-imputed and standardised by the training rows; a column without values becomes zero."""
    known = ~np.isnan(train)
    median = np.array([np.median(train[k, i]) if k.any() else 0.0 for i, k in enumerate(known.T)])
    train, other = (np.where(np.isnan(m), median, m) for m in (train, other))
    mean, scale = train.mean(axis=0), train.std(axis=0)
    scale[scale == 0] = 1.0
    return (train - mean) / scale, (other - mean) / scale


def fit_ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for standardised (hence centred) features."""
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean())), float(y.mean())


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int, least: int, penalty: float) -> list:
    """Gradient boosting for squared error over quantile bins; missing values take the last bin."""
    edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, 33)[1:-1])) if np.isfinite(c).any() else np.zeros(0) for c in x.T]
    bins = _binned(x, edges)
    trees, now = [("base", float(y.mean()), edges)], np.full(len(y), y.mean())
    for _ in range(rounds):
        tree = _grow(bins, y - now, np.arange(len(y)), depth, least, penalty)
        now = now + rate * _descend(tree, bins)
        trees.append(tree)
    return trees


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.where(np.isnan(c), len(e) + 1, np.searchsorted(e, c, side="right")) for c, e in zip(x.T, edges, strict=True)])


def _grow(bins: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, least: int, penalty: float):
    total, n = residual[rows].sum(), len(rows)
    best = None
    if depth and n >= 2 * least:
        for j in range(bins.shape[1]):
            counts = np.cumsum(np.bincount(bins[rows, j]))
            sums = np.cumsum(np.bincount(bins[rows, j], residual[rows]))
            ok = (counts >= least) & (n - counts >= least)
            gain = np.where(ok, sums**2 / (counts + penalty) + (total - sums) ** 2 / (n - counts + penalty), -np.inf)
            at = int(gain.argmax())
            if gain[at] > total**2 / (n + penalty) + 1e-15 and (best is None or gain[at] > best[0]):
                best = gain[at], j, at
    if best is None:
        return float(total / (n + penalty))
    _, j, at = best
    left = bins[rows, j] <= at
    return j, at, _grow(bins, residual, rows[left], depth - 1, least, penalty), _grow(bins, residual, rows[~left], depth - 1, least, penalty)


def _descend(tree, bins: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(bins), tree)
    j, at, low, high = tree
    return np.where(bins[:, j] <= at, _descend(low, bins), _descend(high, bins))


def predict_trees(trees: list, x: np.ndarray, rate: float) -> np.ndarray:
    _, base, edges = trees[0]
    bins = _binned(x, edges)
    return base + rate * sum((_descend(t, bins) for t in trees[1:]), np.zeros(len(x)))


def walk_forward(folded: DataFrame, columns: tuple[str, ...], family: str = "ridge", alpha: float = 1.0, rounds: int = 30, rate: float = 0.1, depth: int = 3, least: int = 10, penalty: float = 1.0) -> DataFrame:
    """Validation predictions of a model for each symbol, fold and horizon; ``folded`` rows are resolved and carry ``side``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("decision_time")
        train, check = pdf[pdf.side == "train"], pdf[pdf.side == "validation"]
        if train.empty or check.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in SCORED.split(", ")])
        out = check.copy()
        a, b = train[list(columns)].to_numpy(float), check[list(columns)].to_numpy(float)
        if family == "ridge":
            a, b = _prepared(a, b)
        for target in ("long", "short"):
            y = train[f"{target}_return"].to_numpy(float)
            if family == "ridge":
                w, c = fit_ridge(a, y, alpha)
                out[f"predicted_{target}_return"] = b @ w + c
            else:
                out[f"predicted_{target}_return"] = predict_trees(fit_trees(a, y, rounds, rate, depth, least, penalty), b, rate)
        return out[[c.split()[0] for c in SCORED.split(", ")]]

    needed = [*KEYS, "side", "decision_time", "entry_time", "exit_time", "long_return", "short_return", *columns]
    return folded.select(*needed).groupBy(*KEYS).applyInPandas(fit, SCORED)


def inner_selection(scores: DataFrame) -> DataFrame:
    """(symbol, horizon_minutes, candidate): the candidate with the greatest mean inner score, earlier ones first on ties.

    ``scores`` has (symbol, horizon_minutes, candidate, candidate_index, score), a row for each inner fold.
    """
    mean = scores.groupBy("symbol", "horizon_minutes", "candidate", "candidate_index").agg(F.avg("score").alias("mean"))
    return mean.groupBy("symbol", "horizon_minutes").agg(F.max_by("candidate", F.struct("mean", -F.col("candidate_index"))).alias("candidate"))
