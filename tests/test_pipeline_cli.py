import json

import pytest
from pyspark.sql import functions as F

from quotewright import cli
from quotewright.contracts import MINUTE, PAIRS, SECOND, WalkForwardPlan
from quotewright.plans import pipeline
from quotewright.sources import sinks

from .helpers import START, TICKS


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Three ticks a bar for eight pairs over ten hours."""
    rows = []
    for k, pair in enumerate(PAIRS):
        for i in range(360):
            bid = 1 + ((i * (7 + k)) % 23) / 10_000
            rows.append((pair, START + i * 100 * SECOND + k, i, bid, bid + 0.0002, (bid + (bid + 0.0002)) / 2, (bid + 0.0002) - bid))
    path = f"{tmp_path_factory.mktemp('ticks')}/ticks"
    spark.createDataFrame(rows, TICKS).write.parquet(path)
    return path


def test_development_runs_and_resumes(spark, source, tmp_path):
    plan = WalkForwardPlan(START, START + 360 * MINUTE, START + 600 * MINUTE, step=120 * MINUTE)
    config = pipeline.ResearchConfig(plan)
    ticks = spark.read.parquet(source)
    record = pipeline.run_development(spark, ticks, f"{tmp_path}/run", config)
    named = {c["name"]: c for c in record["checks"]}
    assert named["replay"]["passed"] and named["ledger_reconciles"]["passed"] and named["horizons"]["passed"] and all(named[f"observations_{h}"]["passed"] for h in (15, 30, 60))
    assert record["accepted"] == all(c["passed"] for c in record["checks"])
    again = pipeline.run_development(spark, ticks.where("false"), f"{tmp_path}/run", config)
    assert again == record
    assert pipeline.run_id(config, "a") != pipeline.run_id(config, "b")


def test_critical_ticks_stop_the_run(spark, source, tmp_path):
    bad = spark.read.parquet(source).withColumn("bid", F.lit(9.0))
    with pytest.raises(ValueError):
        pipeline.run_development(spark, bad, f"{tmp_path}/run", pipeline.ResearchConfig(WalkForwardPlan(START, START + 360 * MINUTE, START + 600 * MINUTE, step=120 * MINUTE)))


def test_commands(spark, source, tmp_path, capsys):
    assert cli.main(["audit-ticks", "--ticks", source]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 8
    assert cli.main(["build-bars", "--ticks", source, "--bar-set", "quote-bars-v2", "--output", f"{tmp_path}/bars", "--end-exclusive", str(START + 120 * MINUTE)]) == 0
    assert cli.main(["build-features", "--bars", f"{tmp_path}/bars", "--output", f"{tmp_path}/features"]) == 0
    assert cli.main(["build-labels", "--bars", f"{tmp_path}/bars", "--horizons-minutes", "5", "15", "--output", f"{tmp_path}/labels"]) == 0
    features, labels = (sinks.read_table(spark, f"{tmp_path}/{n}", c, bars="quote-bars-v2") for n, c in (("features", "causal-v2"), ("labels", "executable-v1")))
    assert features.count() == labels.count() == 24 * 8 and "action_5m" in labels.columns
    sinks.require_compatible(features, labels)
    with pytest.raises(ValueError):
        sinks.require_contract(features, "causal-v1")
    with pytest.raises(ValueError):
        sinks.require_compatible(features, sinks.with_contract(labels, "executable-v1", bars="quote-bars-v1"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(labels, f"{tmp_path}/labels")
    sinks.compact(features, f"{tmp_path}/compact", 50, "symbol", "bar_end")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 24 * 8
    assert cli.main(["build-validation", "--train-start", "0", "--first-validation", str(START), "--end", str(START + 86_400 * SECOND * 59), "--output", f"{tmp_path}/plan.json"]) == 0
    assert len(json.loads((tmp_path / "plan.json").read_text())["folds"]) >= 1
    sinks.require_not_null(features, "symbol", "bar_end")
    with pytest.raises(ValueError):
        sinks.require_not_null(features, "mid_return_1")
