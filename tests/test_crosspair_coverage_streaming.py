import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotewright.contracts import BAR, CURRENCIES, PAIRS, SECOND
from quotewright.functions.calendar import expected_boundaries
from quotewright.functions.expressions import elapsed_seconds_log1p
from quotewright.operators import bars as B
from quotewright.operators import coverage as C
from quotewright.operators import crosspair as X
from quotewright.operators import evaluation as E
from quotewright.operators import quality as Q
from quotewright.plans import records as R
from quotewright.streaming.bars import RECEIPT_SCHEMA, BarStream, stream_bars

from .helpers import START, us

FEATURES = "symbol string, bar_end long, mid_return_1 double"


def section(spark, values, boundaries=(0,)):
    return spark.createDataFrame([(p, START + b * BAR, float(v)) for b in boundaries for p, v in zip(PAIRS, values, strict=True)], FEATURES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_factor(spark, seed):
    """Strengths against a least-squares solution of return = base - quote with the dollar at zero."""
    values = np.random.default_rng(seed).normal(0, 0.01, len(PAIRS))
    others = [c for c in CURRENCIES if c != "USD"]
    sides = np.array([[(p[:3] == c) - float(p[3:] == c) for c in others] for p in PAIRS])
    # The cross pair alone fixes the franc where no dollar pair does, so the system has one solution for each currency.
    r = X.solve(X.returns_at(section(spark, values))).first()
    solved = np.array([r[f"strength_{c}"] for c in others])
    residuals = np.array([r[f"residual_{p}"] for p in PAIRS])
    assert residuals == pytest.approx(values - sides @ solved, abs=1e-12)
    assert solved == pytest.approx(np.linalg.lstsq(sides, values, rcond=None)[0], abs=1e-12)
    assert r["dispersion"] == pytest.approx(residuals.std(), abs=1e-12)


def test_windows_reset_at_incomplete_boundaries(spark):
    values = (0.01, 0.01, -0.02, 0.04, -0.11, -0.05, 0.02, -0.06)
    rows = section(spark, values, [*range(14), *range(15, 29)])
    got = {(r.boundary - START) // BAR: r for r in X.cross_pair_features(rows).where("symbol = 'EURUSD'").collect()}
    assert len(got) == 28 and got[1].base_strength_sum_3 is None and got[2].base_strength_sum_3 == pytest.approx(0.12)
    assert got[10].base_strength_sum_12 is None and got[11].base_strength_sum_12 == pytest.approx(0.48) and got[15].base_strength_sum_3 is None
    assert got[12].quote_strength_sum_12 == 0.0 and got[10].quote_strength_sum_12 is None and got[26].base_strength_sum_12 is not None and got[25].base_strength_sum_12 is None


def test_missing_symbols_in_canonical_order(spark):
    rows = section(spark, range(8)).where("symbol NOT IN ('USDJPY', 'EURCHF')")
    r = X.sections(rows).first()
    assert (r.present, r.missing_symbols, r.complete) == (6, "EURCHF,USDJPY", False)


def test_calendar_week_and_daylight_saving(spark):
    week = [r.boundary for r in expected_boundaries(spark, us(2026, 9, 6), us(2026, 9, 13)).orderBy("boundary").collect()]
    assert len(week) == 1427 and week[0] == us(2026, 9, 6, 21, 5) and week[-1] == us(2026, 9, 11, 19, 55)
    for day, first in (((2026, 11, 1), (2026, 11, 1, 22, 5)), ((2026, 3, 8), (2026, 3, 8, 21, 5))):
        assert expected_boundaries(spark, us(*day), us(*day) + 288 * BAR).agg(F.min("boundary")).first()[0] == us(*first)
    assert expected_boundaries(spark, us(2026, 1, 9), us(2026, 1, 10)).agg(F.max("boundary")).first()[0] == us(2026, 1, 9, 20, 55)


def test_opportunities_and_coverage(spark):
    schema = "boundary long, present long, missing_symbols string, complete boolean"
    sections = spark.createDataFrame([(START, 8, "", True), (START + BAR, 7, "EURUSD", False), (START + 2 * BAR, 8, "", True)], schema)
    ready = spark.createDataFrame([(START,), (START + BAR,), (START + 2 * BAR,)], "boundary long")
    available = spark.createDataFrame([(START, START + SECOND), (START + 2 * BAR, START + 3 * BAR + 1)], "boundary long, feature_available_at long")
    status = C.boundary_status(sections, ready, available)
    ledger = C.opportunities(status)
    assert ledger.count() == 144 and all(r.cells == r.n_rows == 48 and r.uniform for r in C.ledger_check(ledger).collect())
    C.require_blind(ledger)
    with pytest.raises(ValueError):
        C.require_blind(ledger.withColumn("inner", F.struct(F.lit(1).alias("Realized_x"))))
    calendar = spark.createDataFrame([(START + i * BAR,) for i in range(4)], "boundary long")
    seen = C.against_calendar(calendar, status)
    assert [r.status for r in seen.orderBy("boundary").collect()] == ["ready", "missing_input", "late_feature", "absent"]
    whole = C.coverage(seen).where("month IS NULL").first()
    assert (whole.expected, whole.complete, whole.ratio, whole.max_consecutive_missing) == (4, 1, 0.25, 3)


def receipts(rows):
    return [{"symbol": "EURUSD", "provider_ts": START + int(p * SECOND), "received_at": START + int(r * SECOND), "ingest_seq": s, "bid": 1.0999, "ask": 1.1001, "mid": 1.1, "spread": 0.0002} for p, r, s in rows]


GOOD = [(10, 10.01, 1), (290, 290.01, 2), (300, 300.2, 3), (301, 301.1, 4), (720, 720.1, 5), (1000, 1000.1, 6)]


def test_watermark_final_bar():
    stream = BarStream("EURUSD")
    out = [row for t in receipts(GOOD[:3]) for row in stream.push(t)]
    assert len(out) == 1 and out[0]["quote_count"] == 2
    assert out[0]["bar_finalized_at"] == START + 300_200_000 and out[0]["feature_available_at"] == START + 301_200_000


@pytest.mark.parametrize("bad, error", [((299, 400, 9), "provider"), ((800, 100, 9), "receipt"), ((800, 800, 2), "ingest")])
def test_late_input_ends_the_stream(bad, error):
    stream = BarStream("EURUSD")
    for t in receipts(GOOD[:3]):
        stream.push(t)
    out = stream.push(receipts([bad])[0])
    assert out[0]["error"].startswith(error) and stream.failed and stream.push(receipts([(2000, 2000, 50)])[0]) == []
    assert out[0]["invalidated_boundary"] == (START + BAR if error == "provider" else None)
    assert BarStream("EURUSD", stream.state()).push(receipts([(3000, 3000, 60)])[0]) == []


@pytest.mark.parametrize("cuts", [(6,), (1, 2, 3, 4, 5, 6)])
def test_stream_does_not_depend_on_batches(spark, tmp_path, cuts):
    rows, at = receipts(GOOD), 0
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(RECEIPT_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    job = stream_bars(source).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").format("parquet").start(f"{tmp_path}/out")
    try:
        for n, cut in enumerate(cuts):
            part = tmp_path / f"{n}.json"
            part.write_text("\n".join(map(json.dumps, rows[at:cut])))
            part.rename(tmp_path / "in" / part.name)
            at = cut
            job.processAllAvailable()
    finally:
        job.stop()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("bar_start").collect()
    batch = B.prospective_bars(spark.createDataFrame([tuple(r.values()) for r in rows], RECEIPT_SCHEMA).withColumn("seq", F.col("ingest_seq")))
    want = batch.orderBy("bar_start").collect()
    assert [tuple(r[c] for c in batch.columns) for r in got] == [tuple(r) for r in want] and len(got) == 3
    assert all(r.violations == 0 for r in Q.prospective_bar_checks(batch).collect())


def test_receipt_audit_stops_at_nulls(spark):
    rows = [tuple(r.values()) for r in receipts([(10, 10, 1), (5, 9, 1)])]
    a = Q.receipt_audit(spark.createDataFrame(rows, RECEIPT_SCHEMA).withColumn("seq", F.monotonically_increasing_id())).first()
    assert (a.provider_out_of_order, a.receipt_out_of_order, a.sequence_not_increasing, a.max_delivery_latency) == (1, 1, 1, 4 * SECOND)
    with_null = spark.createDataFrame(rows, RECEIPT_SCHEMA).withColumn("bid", F.lit(None).cast("double")).withColumn("seq", F.monotonically_increasing_id())
    a = Q.receipt_audit(with_null).first()
    assert (a.n_rows, a.null_values, a.receipt_out_of_order) == (2, 2, 0)


def test_custody_chain(spark):
    schema = "symbol string, sequence long, segment_id string, previous_segment_id string, n_rows long, critical_violations long"
    good = [("X", 0, "a", None, 5, 0), ("X", 1, "b", "a", 6, 1), ("Y", 0, "c", None, 1, 0), ("Y", 2, "d", "x", 1, 0)]
    got = {r.symbol: (r.segments, r.n_rows, r.critical_violations, r.breaks, r.terminal_segment_id) for r in E.custody_chain(spark.createDataFrame(good, schema)).collect()}
    assert got == {"X": (2, 11, 1, 0, "b"), "Y": (2, 2, 0, 1, "d")}


def test_records(tmp_path):
    assert R.canonical_json({"b": 1, "a": [1.5, None]}) == b'{"a":[1.5,null],"b":1}'
    with pytest.raises(ValueError):
        R.canonical_json(float("nan"))
    path = tmp_path / "r.json"
    assert R.write_immutable_json(path, {"a": 1}) == R.content_id({"a": 1}) and R.read_strict_json(path) == {"a": 1}
    with pytest.raises(FileExistsError):
        R.write_immutable_json(path, {})
    for text in ('{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            R.read_strict_json(tmp_path / "bad.json")


def test_stage_runner(tmp_path):
    runs = []
    runner = R.StageRunner(tmp_path, {"v": 1})
    stage = lambda out: (runs.append(1), (out / "x").write_text("data"))
    assert runner.run("a", stage) and not runner.run("a", stage) and len(runs) == 1
    with pytest.raises(ValueError):
        R.StageRunner(tmp_path, {"v": 2}).run("a", stage)
    (tmp_path / "a" / "x").write_text("altered")
    with pytest.raises(ValueError):
        runner.run("a", stage)


def test_opportunity_means_count_the_calendar(spark):
    calendar = spark.createDataFrame([(START + i * BAR,) for i in range(4)], "boundary long")
    scored = spark.createDataFrame([("control", "EURUSD", START, 15, "long"), ("control", "EURUSD", START + BAR, 15, "short"), ("candidate", "EURUSD", START, 15, "flat")], "arm string, symbol string, decision_time long, horizon_minutes int, action string")
    labels = spark.createDataFrame([("EURUSD", START, 15, 0.01, -0.02)], "symbol string, decision_time long, horizon_minutes int, long_return double, short_return double")
    means = C.opportunity_means(calendar, scored, labels)
    r = means.where("arm = 'control' AND symbol = 'EURUSD' AND horizon_minutes = 15").first()
    assert means.count() == 48 and (r.scored, r.nonflat_signals, r.trade_count, r.resolved_labels) == (2, 2, 1, 1) and r.mean_bps == pytest.approx(25)
    d = C.arm_delta(means).where("symbol = 'EURUSD' AND horizon_minutes = 15").first()
    assert d.mean_bps_delta == pytest.approx(-25) and d.trade_count_delta == -1


@pytest.mark.parametrize("stretch", [1, 3, 1_000])
def test_rows_meet_the_row_before_across_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(Q, "STRETCH", stretch)
    rows = [("A", s, None if s == 7 else t) for s, t in zip((0, 2, 3, 4, 7, 8, 11, 30, 31), (5, 9, 4, 4, 0, 6, 2, 8, 7), strict=True)] + [("B", 1, 3)]
    got = Q.with_previous(spark.createDataFrame(rows, "symbol string, seq long, ts long"), "ts").collect()
    want = {("A", a[1]): b[2] if b else None for a, b in zip(rows[:-1], [None, *rows[:-2]], strict=True)} | {("B", 1): None}
    assert {(r.symbol, r.seq): r["__before_ts"] for r in got} == want and len(got) == len(rows)
    order = Q.tick_order(spark.createDataFrame(rows, "symbol string, seq long, ts long")).where("symbol = 'A'").first()
    assert (order.out_of_order, order.max_gap) == (3, 6)


def test_elapsed_seconds_log1p(spark):
    df = spark.createDataFrame([(None,), (0.0,), (300.0,)], "x double")
    assert [r.y for r in df.select(elapsed_seconds_log1p(F.col("x")).alias("y")).collect()] == [None, 0.0, pytest.approx(np.log(301))]
    for bad in (-1.0, float("inf"), float("nan")):
        with pytest.raises(Exception, match="elapsed seconds"):
            spark.createDataFrame([(bad,)], "x double").select(elapsed_seconds_log1p(F.col("x"))).collect()
