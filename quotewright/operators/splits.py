"""Purged walk-forward splits and the joins that bind features, labels and folds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import WalkForwardPlan

FOLD_SCHEMA = "fold_id string, fold_index int, train_start long, train_end long, validation_start long, validation_end long"


def _moment(us: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(us // 1_000_000, dt.UTC)


def add_months(us: int, months: int) -> int:
    """The same day and time of a later month; a day that month lacks is an error, not the month's last day."""
    t = _moment(us)
    at = t.year * 12 + t.month - 1 + months
    try:
        moved = t.replace(year=at // 12, month=at % 12 + 1)
    except ValueError:
        raise ValueError(f"{t.date()} has no counterpart {months} months on") from None
    return int(moved.timestamp()) * 1_000_000 + us % 1_000_000


def fold_list(plan: WalkForwardPlan) -> list[tuple]:
    """Validation windows are clipped to ``end`` less the purge, so that every exit lies before ``end``."""
    out, start, n = [], plan.first_validation, 0
    while start < plan.end:
        after = start + plan.step if plan.step else add_months(plan.first_validation, (n + 1) * plan.step_months)
        name = f"wf-{_moment(start):%Y-%m}" if plan.step is None else f"wf-{n:03d}"
        stop = min(after, plan.end - plan.purge)
        if stop > start:
            out.append((name, n, plan.train_start, start - plan.purge, start, stop))
        start, n = after, n + 1
    return out


def folds(spark: SparkSession, plan: WalkForwardPlan) -> DataFrame:
    return spark.createDataFrame(fold_list(plan), FOLD_SCHEMA)


def fold_rows(rows: DataFrame, plan: WalkForwardPlan, time: str = "decision_time") -> DataFrame:
    """Each row once for every fold and side it belongs to. The folds of a plan are a short list, so that side is broadcast."""
    f = F.broadcast(folds(rows.sparkSession, plan))
    t = F.col(time)
    side = F.when((t >= F.col("train_start")) & (t < F.col("train_end")), "train").when((t >= F.col("validation_start")) & (t < F.col("validation_end")), "validation")
    joined = rows.join(f, (t >= F.col("train_start")) & (t < F.col("validation_end")))
    return joined.withColumn("side", side).where("side IS NOT NULL").drop("train_start", "train_end", "validation_start", "validation_end")


def locked_rows(rows: DataFrame, start: int, end: int, purge: int, time: str = "decision_time") -> DataFrame:
    return rows.where((F.col(time) >= start) & (F.col(time) < end - purge))


def align(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and labels of the same symbol and time."""
    return features.withColumnRenamed("bar_end", "decision_time").join(labels, ["symbol", "decision_time"])


def misaligned(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys that only one side has."""
    keys = features.select("symbol", F.col("bar_end").alias("decision_time"))
    other = labels.select("symbol", "decision_time")
    on = ["symbol", "decision_time"]
    return keys.join(other, on, "left_anti").withColumn("only_in", F.lit("features")).unionByName(other.join(keys, on, "left_anti").withColumn("only_in", F.lit("labels")))


def development_slice(aligned: DataFrame, start: int, decision_end: int) -> DataFrame:
    return aligned.where((F.col("decision_time") >= start) & (F.col("decision_time") < decision_end))


def inner_blocks(rows: DataFrame, blocks: int, time: str = "decision_time", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Contiguous blocks (from 0) of each key's rows; the first blocks take one more where the division leaves a rest."""
    return rows.withColumn("block", F.ntile(blocks).over(Window.partitionBy(*keys).orderBy(time)) - 1)


def calibration_side(time: Column, calibration_start: int, train_end: int, purge: int) -> Column:
    """``fit`` up to a purge before the calibration window, ``calibrate`` inside it, else null."""
    return F.when(time < calibration_start - purge, "fit").when((time >= calibration_start) & (time < train_end), "calibrate")
