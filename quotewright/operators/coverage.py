"""Expected opportunities, their coverage against the calendar, and means whose denominator is the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import ARMS, HORIZONS, PAIRS, PUBLICATION_DEADLINE

#: Parts of column names that must not occur in a table that is blind to outcomes.
OUTCOME_PARTS = ("return", "label", "action", "pnl", "profit", "outcome", "realized", "entry", "exit", "score", "prediction")


def require_blind(df: DataFrame) -> None:
    """Raise where a column name, nested ones included, tells of outcomes."""

    def names(schema):
        for f in schema:
            yield f.name
            kind = getattr(f.dataType, "elementType", f.dataType)
            if hasattr(kind, "fields"):
                yield from names(kind)

    found = [n for n in names(df.schema) if any(p in n.lower() for p in OUTCOME_PARTS)]
    if found:
        raise ValueError(f"columns tell of outcomes: {found}")


def cells(spark: SparkSession) -> DataFrame:
    """(arm, symbol, horizon_minutes): 48 rows."""
    arms, pairs, horizons = (F.explode(F.array(*[F.lit(v) for v in vs])) for vs in (ARMS, PAIRS, HORIZONS))
    return spark.range(1).select(arms.alias("arm")).withColumn("symbol", pairs).withColumn("horizon_minutes", horizons)


def boundary_status(sections: DataFrame, ready: DataFrame, available: DataFrame) -> DataFrame:
    """(boundary, deadline, available, status, reason); the first condition that holds counts.

    ``sections`` has (boundary, missing_symbols, complete), ``ready`` the boundaries whose returns are all known, ``available``
    (boundary, feature_available_at).
    """
    rows = sections.join(ready.select("boundary", F.lit(True).alias("ready")), "boundary", "left").join(available, "boundary", "left")
    deadline = F.col("boundary") + PUBLICATION_DEADLINE
    late = F.col("feature_available_at") > deadline
    status = F.when(~F.col("complete"), "missing_input").when(F.col("ready").isNull(), "factor_warmup").when(F.coalesce(late, F.lit(True)), "late_feature").otherwise("ready")
    reason = F.when(~F.col("complete"), F.concat(F.lit("missing_symbols:"), F.col("missing_symbols"))).when(F.col("ready").isNull(), "cross_pair_return_unavailable").when(F.coalesce(late, F.lit(True)), "feature_available_after_publication_deadline")
    return rows.select("boundary", deadline.alias("publication_deadline"), "feature_available_at", status.alias("status"), reason.alias("missing_reason"))


def opportunities(status: DataFrame) -> DataFrame:
    """Every arm, pair and horizon of every boundary, without scores or outcomes."""
    return status.crossJoin(F.broadcast(cells(status.sparkSession))).withColumnRenamed("boundary", "decision_time")


def ledger_check(ledger: DataFrame) -> DataFrame:
    """(decision_time, cells, uniform): boundaries must have 48 different cells and one status, reason and availability."""
    one = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("none"))) == 1 for c in ("status", "missing_reason", "feature_available_at")]
    return ledger.groupBy("decision_time").agg(F.countDistinct("arm", "symbol", "horizon_minutes").alias("cells"), F.count("*").alias("n_rows"), (one[0] & one[1] & one[2]).alias("uniform"))


def against_calendar(calendar: DataFrame, status: DataFrame) -> DataFrame:
    """(boundary, status) of every expected boundary; ``absent`` where the ledger has none."""
    return calendar.join(status.select("boundary", "status"), "boundary", "left").select("boundary", F.coalesce("status", F.lit("absent")).alias("status"))


def coverage(represented: DataFrame) -> DataFrame:
    """By month, and over all (null month): expected and complete boundaries, their ratio, and the longest run that is not complete.

    Runs are found over the calendar's boundaries, of which there are some 100,000 a year however many ticks there are.
    """
    ready = F.col("status") == "ready"
    w = Window.orderBy("boundary")
    rows = represented.withColumn("island", F.sum(ready.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("month", F.date_format(F.timestamp_micros("boundary"), "yyyy-MM"))
    longest = rows.where(~ready).groupBy("island").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_consecutive_missing"))
    sets = rows.groupingSets([["month"], []], "month").agg(F.count("*").alias("expected"), F.count_if(ready).alias("complete"))
    return sets.withColumn("ratio", F.col("complete") / F.col("expected")).crossJoin(longest)


def opportunity_means(calendar: DataFrame, scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Per arm, pair and horizon: means over all expected boundaries, where flat, unscored and unresolved ones count as zero.

    ``scored`` has (arm, symbol, decision_time, horizon_minutes, action), ``labels`` one resolved row for each decision and horizon.
    """
    on = ["symbol", "decision_time", "horizon_minutes"]
    inside = calendar.withColumnRenamed("boundary", "decision_time")
    n = calendar.agg(F.count("*").alias("expected_opportunities"))
    known = labels.join(inside, "decision_time").select(*on, "long_return", "short_return")
    taken = scored.join(inside, "decision_time").join(known, on, "left")
    signal = F.col("action") != "flat"
    trade = signal & F.col("long_return").isNotNull()
    value = F.when(trade & (F.col("action") == "long"), F.col("long_return")).when(trade, F.col("short_return")).otherwise(F.lit(0.0))
    a = taken.groupBy("arm", "symbol", "horizon_minutes").agg(F.count("*").alias("scored"), F.count_if(signal).alias("nonflat_signals"), F.count_if(~signal).alias("flat_actions"), F.count_if(trade).alias("trade_count"), F.sum(value).alias("total"))
    b = known.groupBy("symbol", "horizon_minutes").agg(F.count("*").alias("resolved_labels"))
    out = cells(calendar.sparkSession).join(a, ["arm", "symbol", "horizon_minutes"], "left").join(b, ["symbol", "horizon_minutes"], "left").crossJoin(F.broadcast(n))
    out = out.fillna(0, ["scored", "nonflat_signals", "flat_actions", "trade_count", "resolved_labels"]).fillna(0.0, ["total"])
    return out.withColumn("mean_bps", F.col("total") / F.col("expected_opportunities") * 10_000)


def arm_delta(means: DataFrame) -> DataFrame:
    """(symbol, horizon, deltas candidate less control)."""
    side = {a: means.where(F.col("arm") == a).select("symbol", "horizon_minutes", F.col("mean_bps").alias(f"{a}_bps"), F.col("trade_count").alias(f"{a}_trades")) for a in ARMS}
    joined = side["candidate"].join(side["control"], ["symbol", "horizon_minutes"])
    return joined.select("symbol", "horizon_minutes", (F.col("candidate_bps") - F.col("control_bps")).alias("mean_bps_delta"), (F.col("candidate_trades") - F.col("control_trades")).alias("trade_count_delta"))
