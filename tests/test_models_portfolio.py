import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotewright.contracts import HORIZONS, MINUTE, PAIRS, SECOND, PortfolioConfig, ScreenGates, WalkForwardPlan
from quotewright.operators import evaluation as E
from quotewright.operators import models as M
from quotewright.operators import portfolio as P
from quotewright.operators import quality as Q
from quotewright.operators import splits as S

from .helpers import START, by, us

SMALL = PortfolioConfig(periods_per_year=1.0, lookback=4, minimum_observations=2)


def test_monthly_folds():
    plan = WalkForwardPlan(us(2018, 1, 1), us(2022, 1, 1), us(2025, 1, 1))
    rows = S.fold_list(plan)
    assert len(rows) == 36 and rows[0][0] == "wf-2022-01" and rows[-1][0] == "wf-2024-12"
    assert rows[0][3] == us(2021, 12, 31, 22, 55) and rows[-1][5] == us(2024, 12, 31, 22, 55)


@pytest.mark.parametrize("kwargs", [{"purge": 60 * MINUTE}, {"end": 0}, {"horizons": (30, 15)}, {"horizons": (7,)}, {"step": 60 * MINUTE}])
def test_bad_plans(kwargs):
    with pytest.raises(ValueError):
        WalkForwardPlan(**({"train_start": 1, "first_validation": 10**12, "end": 10**13} | kwargs))


def test_missing_day_is_an_error():
    with pytest.raises(ValueError):
        S.add_months(us(2022, 1, 31), 1)


def test_fold_rows_purge(spark):
    plan = WalkForwardPlan(START, START + 600 * MINUTE, START + 1200 * MINUTE, step=300 * MINUTE)
    rows = spark.range(0, 1200, 5).select((F.lit(START) + F.col("id") * MINUTE).alias("decision_time"))
    got = S.fold_rows(rows, plan).groupBy("fold_id", "side").agg(F.min("decision_time").alias("a"), F.max("decision_time").alias("b"))
    got = {(r.fold_id, r.side): ((r.a - START) // MINUTE, (r.b - START) // MINUTE) for r in got.collect()}
    assert got == {("wf-000", "train"): (0, 530), ("wf-000", "validation"): (600, 895), ("wf-001", "train"): (0, 830), ("wf-001", "validation"): (900, 1130)}


def test_inner_blocks_give_the_rest_first(spark):
    rows = spark.range(10).select(F.lit("X").alias("symbol"), F.col("id").alias("decision_time"))
    got = S.inner_blocks(rows, 3).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in got] == [len(a) for a in np.array_split(np.arange(10), 3)]


def predictions(spark, n=3, value=0.01, symbols=PAIRS, portfolio=True):
    rows = []
    for d in range(n):
        t = START + d * 5 * MINUTE
        for s in symbols:
            for h in HORIZONS:
                rows.append(("p", "wf-000", s, t, t + SECOND, t + h * MINUTE + SECOND, h, 0.1, -0.1, "long", value))
    return spark.createDataFrame(rows, "portfolio_id string, fold_id string, symbol string, decision_time long, entry_time long, exit_time long, horizon_minutes int, predicted_long_return double, predicted_short_return double, action string, realized_return double")


def test_overlapping_lots(spark):
    p = predictions(spark)
    ledger = P.simulate_portfolios(p, "ledger", SMALL)
    summary = P.simulate_portfolios(p, "summary", SMALL).first()
    assert ledger.count() == 72 and summary.maximum_active_positions == 72 and summary.maximum_gross_leverage < 1
    assert P.replay_differences(p, ledger, SMALL).isEmpty()
    path = P.simulate_portfolios(p, "equity", SMALL).orderBy("event_index").collect()
    assert path[0].pnl_usd == 0 and path[-1].active_positions == 0
    assert path[-1].equity_usd == pytest.approx(100_000 + sum(r.pnl_usd for r in path))


def test_zero_volatility_doubles_leverage(spark):
    used = {r.risk_leverage for r in P.simulate_portfolios(predictions(spark, 8, 0.0), "ledger", SMALL).select("risk_leverage").distinct().collect()}
    assert {1.0, 2.0} <= used


def test_drawdown_halts(spark):
    p = predictions(spark, 8, -1.0)
    s = P.simulate_portfolios(p, "summary", SMALL).first()
    last = P.simulate_portfolios(p, "ledger", SMALL).agg(F.max("decision_time")).first()[0]
    path = P.simulate_portfolios(p, "equity", SMALL).orderBy("event_index").collect()
    assert s.halted and s.suppressed_signals > 0 and last < START + 20 * MINUTE and path[-1].active_positions == 0


def test_later_returns_do_not_change_earlier_lots(spark):
    base = predictions(spark, 6)
    changed = base.withColumn("realized_return", F.when(F.col("decision_time") >= START + 20 * MINUTE, -0.5).otherwise(F.col("realized_return")))
    early = [by(P.simulate_portfolios(x, "ledger", SMALL).where(F.col("exit_time") < START + 20 * MINUTE).collect(), "symbol", "horizon_minutes", "decision_time") for x in (base, changed)]
    assert early[0] == early[1] and early[0]


def test_portfolios_are_independent(spark):
    both = predictions(spark).unionByName(predictions(spark, 3, -0.02).withColumn("portfolio_id", F.lit("q")))
    got = by(P.simulate_portfolios(both, "summary", SMALL).collect(), "portfolio_id")
    assert got["p"].final_equity_usd > 100_000 > got["q"].final_equity_usd
    assert got["p"].final_equity_usd == P.simulate_portfolios(predictions(spark), "summary", SMALL).first().final_equity_usd


def test_metrics_and_gates(spark):
    p = predictions(spark, 4)
    m = E.signal_metrics(p).where("fold_id IS NULL AND horizon_minutes = 15").first()
    assert (m.observations, m.trades, m.trade_rate, m.hit_rate) == (32, 32, 1.0, 1.0) and m.mean_bps == pytest.approx(100)
    flat = p.withColumns({"action": F.lit("flat"), "realized_return": F.lit(0.0)})
    assert E.signal_metrics(flat).where("fold_id IS NULL").first().hit_rate is None
    g = E.screen_gates(p, ScreenGates(minimum_trades=4)).first()
    assert g.mean_gate and g.symbol_gate and g.trade_gate and not E.screen_gates(p, ScreenGates()).first().trade_gate


def test_prediction_checks(spark):
    p = predictions(spark, 2)
    assert all(r.violations == 0 for r in Q.prediction_checks(p, PAIRS, HORIZONS).collect())
    bad = p.unionByName(p.limit(1)).withColumn("action", F.when(F.col("symbol") == "EURUSD", "short").otherwise(F.col("action")))
    got = by(Q.prediction_checks(bad, PAIRS[:7], HORIZONS).collect(), "check")
    assert got["unique_key"].violations == 1 and got["action"].violations >= 6 and got["symbol"].violations == 6
    assert all(r.violations == 0 for r in Q.latency_checks(p).collect())


def folded(spark, n=240):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, 3))
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = 0.002 * np.nan_to_num(x[:, 0]) - 0.001 * np.nan_to_num(x[:, 1])
    rows = pd.DataFrame(x, columns=["a", "b", "c"])
    rows = rows.assign(symbol="X", fold_id="f", horizon_minutes=15, decision_time=np.arange(n), entry_time=np.arange(n) + 1, exit_time=np.arange(n) + 2, side=np.where(np.arange(n) < n * 3 // 4, "train", "validation"), long_return=y, short_return=-y)
    return spark.createDataFrame(rows).withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in "abc"}).withColumn("horizon_minutes", F.col("horizon_minutes").cast("int")), rows


@pytest.mark.parametrize("family", ["ridge", "trees"])
def test_models_learn(spark, family):
    df, rows = folded(spark)
    got = M.walk_forward(df, ("a", "b", "c"), family).toPandas().sort_values("decision_time")
    want = rows[rows.side == "validation"]
    assert len(got) == 60 and np.corrcoef(got.predicted_long_return, want.long_return)[0, 1] > 0.9


def test_ridge_equals_the_closed_form_and_the_frozen_column(spark):
    df, rows = folded(spark)
    got = M.walk_forward(df, ("a",), "ridge").toPandas().sort_values("decision_time").predicted_long_return.to_numpy()
    train = df.where("side = 'train'")
    stats = M.train_stats(train, ("a",), "symbol").first()
    filled = train.withColumn("a", F.coalesce("a", F.lit(stats.median)))
    fit = M.ridge_closed_form(filled, "a", "long_return", 1.0, "symbol").first()
    model = M.FrozenModel(fit.intercept, {"a": M.FrozenTerm(stats.median, stats["mean"], stats["scale"], fit.slope)})
    frozen = M.frozen_scores(df.where("side = 'validation'").drop("horizon_minutes"), {15: (model, model)}).toPandas().sort_values("decision_time")
    assert np.allclose(frozen.predicted_long_return, got, atol=1e-12)
    with pytest.raises(ValueError):
        M.FrozenModel(0.0, {"a": M.FrozenTerm(0, 0, 0.0, 1)})


def test_all_missing_column_is_harmless():
    x = np.column_stack([np.arange(6.0), np.full(6, np.nan)])
    a, b = M._prepared(x[:4], x[4:])
    assert np.isfinite(a).all() and np.isfinite(b).all()


def test_action_rule(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.2, 0.1), (0.1, 0.2), (0.1, 0.1), (-0.1, -0.2)], "l double, s double")
    assert [r[0] for r in rows.select(M.action(F.col("l"), F.col("s"))).collect()] == ["flat", "long", "short", "short", "flat"]


def test_gates(spark):
    df, _ = folded(spark)
    scored = M.walk_forward(df, ("a", "b"), "ridge").withColumn("spread_zscore_72", F.lit(0.5))
    keys = ("symbol", "fold_id", "horizon_minutes")
    admitted = []
    for q in (1.0, 0.5, 0.1):
        cuts = M.conviction_cut(scored, q, 0.0, *keys)
        admitted.append(M.gated_mean(scored, cuts, 0.0, None, *keys).first().admitted)
    assert admitted[0] > admitted[1] > admitted[2] > 0
    assert M.conviction_cut(scored, 0.5, 10.0, *keys).first().threshold == float("inf")
    cuts = M.conviction_cut(scored, 1.0, 0.0, *keys)
    assert M.gated_mean(scored, cuts, 0.0, 0.0, *keys).first().admitted == 0


def test_calibrator_never_slopes_down(spark):
    rows = spark.createDataFrame([("u", float(i), 2.0 * i + 1) for i in range(5)] + [("d", float(i), -1.0 * i) for i in range(5)] + [("c", 1.0, float(i)) for i in range(5)], "k string, x double, y double")
    got = by(M.calibrator(rows, "x", "y", "k").collect(), "k")
    assert got["u"].slope == pytest.approx(2) and got["u"].intercept == pytest.approx(1)
    assert got["d"].slope == 0 and got["d"].intercept == pytest.approx(-2) and got["c"].slope == 0


def test_selection_prefers_earlier_on_ties(spark):
    rows = spark.createDataFrame([("X", 15, "a", 0, 1.0), ("X", 15, "b", 1, 1.0), ("X", 30, "a", 0, 0.5), ("X", 30, "b", 1, 0.7)], "symbol string, horizon_minutes int, candidate string, candidate_index int, score double")
    assert {r.horizon_minutes: r.candidate for r in M.inner_selection(rows).collect()} == {15: "a", 30: "b"}
