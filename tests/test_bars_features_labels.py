import math

import pytest
from pyspark.sql import functions as F

from quotewright.contracts import BAR, FEATURES_V1, MINUTE, SECOND
from quotewright.operators import bars as B
from quotewright.operators import features as W
from quotewright.operators import labels as L
from quotewright.operators import quality as Q
from quotewright.sources import ticks as T

from .helpers import START, TICKS, bar_ticks, by, ticks


def test_quality_counters(spark):
    rows = [("X", START, 0, 1.0, 1.1, 1.05, 0.1), ("X", START + SECOND, 1, 1.0, 1.1, 1.05, 0.1), ("X", START + SECOND, 2, 1.0, 1.1, 1.05, 0.1), ("X", START, 3, 2.0, 1.0, 0.0, 0.0)]
    rows = [(*r[:6], r[4] - r[3]) if i < 3 else r for i, r in enumerate(rows)]
    got = Q.tick_audit(spark.createDataFrame(rows, TICKS)).first()
    assert (got.n_rows, got.crossed_quotes, got.inconsistent_mid, got.inconsistent_spread, got.out_of_order, got.duplicates, got.critical_violations) == (4, 1, 1, 1, 1, 1, 5)


def test_nan_is_not_crossed(spark):
    nan = float("nan")
    got = Q.tick_quality(spark.createDataFrame([("X", 0, 0, nan, 1.0, nan, nan), ("X", 1, 1, None, 1.0, 1.0, 1.0)], TICKS)).first()
    assert (got.null_values, got.non_finite_values, got.crossed_quotes, got.inconsistent_mid, got.inconsistent_spread) == (1, 3, 0, 0, 0)


def test_bar_boundary_is_half_open(spark):
    got = B.quote_bars_v1(ticks(spark, [(1, 1.0, 1.1), (299, 1.2, 1.3), (300, 2.0, 2.1)])).orderBy("bar_start").collect()
    assert [(r.bid_open, r.bid_close, r.quote_count, r.staleness_ns) for r in got] == [(1.0, 1.2, 2, 1_000_000_000), (2.0, 2.0, 1, 300_000_000_000)]


def test_transitions(spark):
    got = B.quote_bars_v2(ticks(spark, [(1, 1.0, 1.2), (2, 1.1, 1.2), (4, 1.1, 1.3), (7, 1.2, 1.3)])).first()
    assert (got.bid_update_count, got.ask_update_count, got.mid_uptick_count, got.mid_downtick_count, got.spread_widening_count, got.spread_narrowing_count) == (2, 1, 3, 0, 1, 2)
    assert got.bid_ask_update_imbalance == pytest.approx(1 / 3) and got.mid_tick_imbalance == 1 and got.spread_change_imbalance == pytest.approx(-1 / 3)
    assert got.interarrival_dispersion_seconds == pytest.approx(math.sqrt(2 / 3))


def test_transitions_stay_inside_bars(spark):
    rising = [(1, 1.0, 1.1), (240, 1.1, 1.2), (300, 1.2, 1.3), (360, 1.3, 1.4)]
    assert [r.mid_uptick_count for r in B.quote_bars_v2(ticks(spark, rising)).orderBy("bar_start").collect()] == [1, 1]


def test_v2_holds_v1_whatever_the_partitions(spark):
    t = ticks(spark, [(i * 37, 1 + (i * 7 % 11) / 100, 1.2 + (i * 5 % 7) / 100) for i in range(80)])
    one = B.quote_bars_v1(t.coalesce(1)).orderBy("bar_start").collect()
    assert B.quote_bars_v1(t.repartition(5)).orderBy("bar_start").collect() == one
    assert B.project_v1(B.quote_bars_v2(t.repartition(3))).orderBy("bar_start").collect() == one


@pytest.fixture(scope="module")
def hundred(spark):
    return B.quote_bars_v2(bar_ticks(spark, range(0, 500, 5), [1 + i / 10_000 for i in range(100)]))


def test_warm_up(hundred):
    rows = W.features_v2(hundred).orderBy("bar_end").collect()
    first = {c: next((i for i, r in enumerate(rows) if r[c] is not None), None) for c in rows[0].asDict()}
    assert (first["mid_return_1"], first["mid_return_3"], first["mid_return_12"], first["realized_volatility_12"], first["realized_volatility_72"], first["spread_zscore_72"]) == (1, 3, 12, 12, 72, 71)
    assert (first["elapsed_seconds"], first["mid_tick_imbalance_15m"], first["interarrival_dispersion_seconds_60m"]) == (1, 2, 11)
    r = rows[20]
    assert r.mid_return_1 == pytest.approx(math.log((1.002 + 0.0001) / (1.0019 + 0.0001)), rel=1e-9)


def test_future_does_not_change_the_past(spark, hundred):
    bids = [1 + i / 10_000 + (0.2 if i >= 50 else 0) for i in range(100)]
    jumped = B.quote_bars_v2(bar_ticks(spark, range(0, 500, 5), bids))
    cut = START + 50 * BAR
    same = [W.features_v1(b).where(F.col("bar_end") <= cut).orderBy("bar_end").collect() for b in (hundred, jumped)]
    assert same[0] == same[1] and len(same[0]) == 50


def test_gap_resets_windows(spark):
    offsets = [*range(0, 100, 5), *range(220, 320, 5)]
    rows = W.features_v1(B.quote_bars_v1(bar_ticks(spark, offsets, [1 + i / 1000 for i in range(40)]))).orderBy("bar_end").collect()
    assert rows[20].mid_return_1 is None and rows[20].elapsed_seconds == 125 * 60 and rows[21].mid_return_1 is not None
    assert rows[31].realized_volatility_12 is None and rows[32].realized_volatility_12 is not None


def test_constant_spread_scores_zero(spark):
    t = ticks(spark, [(i * 300 + 1, 1.0, 1.25) for i in range(73)])
    rows = W.features_v1(B.quote_bars_v1(t)).orderBy("bar_end").collect()
    assert rows[70].spread_zscore_72 is None and rows[71].spread_zscore_72 == 0.0


def test_rolling_imbalance_is_a_ratio_of_sums(spark, hundred):
    rows = hundred.orderBy("bar_start").limit(3).withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.orderBy("bar_start")))
    rows = rows.withColumns({"bid_update_count": F.when(F.col("n") == 1, 9).otherwise(0).cast("long"), "ask_update_count": F.lit(1).cast("long")}).drop("n")
    assert W.features_v2(rows).orderBy("bar_end").collect()[2].bid_ask_update_imbalance_15m == 0.5


def test_labels(spark):
    bars = B.quote_bars_v1(bar_ticks(spark, range(0, 70, 5), [1 + i / 100 for i in range(14)], 0.01))
    rows = L.executable_labels(bars).orderBy("decision_time").collect()
    r = rows[0]
    assert (r.entry_bid, r.entry_ask) == (pytest.approx(1.01), pytest.approx(1.02))
    assert r.long_return_15m == pytest.approx(1.04 / 1.02 - 1) and r.short_return_15m == pytest.approx(1 - 1.05 / 1.01) and r.action_15m == "long"
    assert rows[-1].exit_time_60m is None and len(rows) == 14
    assert L.unresolved_mixtures(L.executable_labels(bars)).isEmpty()


def test_label_gap_leaves_all_null(spark):
    rows = L.executable_labels(B.quote_bars_v1(bar_ticks(spark, [0, 120], [1.0, 1.1], 0.01))).orderBy("decision_time").collect()
    assert all(v is None for k, v in rows[0].asDict().items() if k not in ("symbol", "decision_time"))


def test_deadlines_are_inclusive(spark):
    late = ticks(spark, [(1, 1.0, 1.01), (600, 1.1, 1.11), (1500, 1.2, 1.21)])
    r = L.executable_labels(B.quote_bars_v1(late), (15,)).orderBy("decision_time").first()
    assert r.entry_time == START + 600 * SECOND and r.exit_time_15m == START + 1500 * SECOND
    missed = ticks(spark, [(1, 1.0, 1.01), (600, 1.1, 1.11), (1500.000001, 1.2, 1.21)])
    r = L.executable_labels(B.quote_bars_v1(missed), (15,)).orderBy("decision_time").first()
    assert r.entry_time is not None and r.exit_time_15m is None


@pytest.mark.parametrize("bad", [(), (7,), (30, 15), (15, 15), (0,)])
def test_bad_horizons(bad):
    with pytest.raises(ValueError):
        L.check_horizons(bad, 0.0)


def test_scans_push_down(spark, tmp_path):
    t = ticks(spark, [(i, 1.0, 1.1) for i in range(50)])
    t.write.parquet(f"{tmp_path}/t")
    scan = T.scan_range(spark.read.parquet(f"{tmp_path}/t"), START + 10 * SECOND, START + 20 * SECOND)
    assert scan.count() == 10
    plan = scan.select("bid")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "spread" not in plan.split("ReadSchema")[1]


def test_dataset_scan_and_files(spark, tmp_path):
    for symbol in ("EURUSD", "GBPUSD"):
        bar_ticks(spark, range(0, 20, 5), [1.0] * 4).drop("symbol").coalesce(1).write.parquet(f"{tmp_path}/data/{symbol}")
    got = T.scan_dataset(spark, f"{tmp_path}/data").groupBy("symbol").count().collect()
    assert {(r.symbol, r["count"]) for r in got} == {("EURUSD", 4), ("GBPUSD", 4)}
    found = T.file_hashes(spark, f"{tmp_path}/data").where(F.col("path").endswith(".parquet"))
    manifest = spark.createDataFrame(found.collect(), found.schema)
    assert T.verify_files(found, manifest).isEmpty()
    altered = manifest.withColumn("sha256", F.when(F.col("path").contains("EURUSD"), "0").otherwise(F.col("sha256"))).unionByName(manifest.limit(1).withColumn("path", F.lit("gone")))
    assert sorted(r.status for r in T.verify_files(found, altered).collect()) == ["altered", "missing"]
    a, b = (T.dataset_manifest(spark, f"{tmp_path}/data") for _ in range(2))
    assert a == b and len(a["dataset_id"]) == 64


def test_split_plan():
    assert T.split_plan([4, 4, 4, 9, 1], 8) == [[0, 1], [2], [3], [4]]
    assert T.split_plan([], 8) == []


def test_checks_find_faults(spark, hundred):
    assert all(r.violations == 0 for r in Q.bar_checks(hundred).collect() + Q.label_bar_checks(hundred).collect())
    broken = hundred.withColumn("mid_low", F.lit(9.0)).withColumn("bar_end", F.col("bar_end") + 1)
    got = by(Q.bar_checks(broken).collect(), "check")
    assert got["prices"].violations == got["span"].violations == got["grid"].violations == 100
    with pytest.raises(ValueError):
        Q.require_none(broken, "broken")


def test_tick_schema():
    assert set(FEATURES_V1) and MINUTE == 60 * SECOND
