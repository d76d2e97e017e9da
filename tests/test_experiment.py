"""The simulator, online tests, remaining models, streaming and a whole run, by their properties."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lumora.experiment import Experiment
from lumora.models.catalog import build
from lumora.operators.evaluate import evaluate, top_lists
from lumora.operators.online import split_test
from lumora.report import past_runs, save
from lumora.sources.catalog import load
from lumora.sources.simulator import Settings, generate
from lumora.streaming.sessions import live_sessions


@pytest.fixture(scope="module")
def data(spark):
    return load(spark, "simulated", n_users=120, items_per_vertical=25, sessions=8.0)


def test_the_simulated_log_repeats(spark):
    s = Settings(n_users=30, items_per_vertical=10)
    a, b = generate(spark, s).events, generate(spark, s).events.repartition(5)
    assert a.count() > 50 and a.exceptAll(b).count() == 0
    assert generate(spark, s).impressions.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 10


def test_an_unknown_dataset(spark):
    with pytest.raises(KeyError, match="orders"):
        load(spark, "nowhere")


def test_ablation_is_the_weight_zero(spark, data):
    rows = data.eval_rows()
    off, zero = (build("graph_walk", p).fit(data).score(rows).select("user_id", "target", "item_id", F.round("score", 9).alias("s")) for p in ({"cross_vertical": False}, {"transfer_weight": 0.0}))
    assert off.exceptAll(zero).count() == zero.exceptAll(off).count() == 0


@pytest.mark.parametrize("kind", ["bpr_mf", "als", "sasrec", "sasrec_session"])
def test_models_run(spark, data, kind):
    rows = data.eval_rows()
    model = build(kind, {"epochs": 2}).fit(data)
    found = evaluate(model, rows, data)
    assert found.metrics["n"] == rows.count() and 0 < found.primary < 1


def test_a_split_test_of_one_ranker(spark, data):
    model = build("popularity").fit(data)
    top = top_lists(model.scores(data.eval_rows()), data)
    found = split_test(top, top, data.log)
    assert not found["significant"] and found["ci_low"] <= found["abs_lift"] <= found["ci_high"]


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:10:00"), (1, "c", "2024-01-01 02:00:00"), (2, "d", "2024-01-03 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, item_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = live_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.user_id, r.n, r.last_item) for r in spark.table("sessions").collect()) == [(1, 1, "c"), (1, 2, "b")]


def test_a_run(spark, data, tmp_path):
    run = Experiment(data, max_rounds=1).run()
    assert run.decision["champion"] in run.state.results and run.stopped
    assert not [r.error for r in run.state.results.values() if r.error] and len(run.state.results) == 4
    save(spark, run, f"{tmp_path}/one")
    assert json.loads((tmp_path / "one/run.json").read_text())["decision"]["champion"] == run.decision["champion"]
    assert past_runs(spark, str(tmp_path)).first().champion == run.decision["champion"]
    assert "## Leaderboard" in (tmp_path / "one/report.md").read_text()
