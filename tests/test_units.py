"""Literal frames and driver-side rules."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumora.functions.stats import bootstrap, sample_size
from lumora.models import walk
from lumora.models.catalog import build
from lumora.models.sequence import attend, gradients
from lumora.operators.compare import in_slice, interleave
from lumora.operators.dataset import Dataset
from lumora.operators.evaluate import Evaluation, check_finite, metrics_by_slice, rank_targets, with_metrics
from lumora.planner import State, choose_actions, judge, plan_round, prune, reconcile, resolve, should_stop
from lumora.schema import require


@pytest.fixture
def small(spark):
    """Two users of one vertical; user 1 has seen item 2, its target is item 1; user 2 has a history item as its target."""
    events = [(1, 2, "v", 1, "train"), (1, 1, "v", 2, "test"), (2, 1, "v", 1, "train"), (2, 3, "v", 2, "train"), (2, 4, "v", 3, "train"), (2, 1, "v", 4, "test")]
    log = spark.createDataFrame([(*e[:4], e[0], (e[3],), e[4]) for e in events], "user_id long, item_id long, vertical string, ts long, session_id long, tiebreak struct<a:int>, part string")
    items = spark.createDataFrame([(i, "v", "v:a", 1) for i in range(1, 5)], "item_id long, vertical string, category string, price_band int")
    return Dataset(log, items)


def scored(spark, rows):
    return spark.createDataFrame([(u, t, "v", i, s) for u, t, i, s in rows], "user_id long, target long, vertical string, item_id long, score double")


def test_ranks(spark, small):
    rows = small.eval_rows()
    rank = lambda scores, dense: {r.user_id: r["rank"] for r in rank_targets(rows, scored(spark, scores), small, dense).collect()}
    ties = [(1, 1, i, 5.0) for i in range(1, 5)] + [(2, 1, i, 0.0) for i in range(1, 5)]
    assert rank(ties, True) == {1: 3, 2: 2}  # seen items are masked, but for the target; ties go against it
    assert rank([(1, 1, 1, 2.0), (1, 1, 2, 9.0), (1, 1, 3, 2.0)], False) == {1: 2, 2: 2}
    with pytest.raises(PySparkException, match="non-finite"):
        rank([(1, 1, 1, float("nan"))], True)
    bad = scored(spark, [(1, 1, 1, None), (1, 1, 2, float("nan")), (1, 1, 3, float("-inf")), (1, 1, 4, 1.0)])
    assert check_finite(bad).first().n_bad == 3


def test_slices_need_thirty_rows(spark):
    rows = spark.range(59).select(F.lit(1).alias("rank"), (F.col("id") < 30).alias("tail_target"), (F.col("id") < 29).alias("transfer_only"))
    found = {r["slice"]: r.n for r in metrics_by_slice(with_metrics(rows)).collect()}
    assert found == {"all": 59, "tail_target": 30}
    assert in_slice(rows, "cold_in_vertical") is None and in_slice(rows, "nowhere") is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        require(spark.range(1).withColumnRenamed("id", "a"), ("a", "b", "c"), "the log")


def test_bootstrap_and_power():
    rng = np.random.default_rng(0)
    values = np.array([-0.1, 0.0, 0.3])
    counts = np.array([50, 400, 100])
    interval = bootstrap(values, counts)
    plain = rng.choice(np.repeat(values, counts), (2000, 550)).mean(axis=1)
    assert interval.low < interval.mean < interval.high and interval.significant and 0 <= interval.p_value <= 1
    assert interval.low == pytest.approx(np.percentile(plain, 2.5), abs=0.003)
    assert np.isnan(bootstrap([], []).mean)
    assert sample_size(0.1, 1.0) == 1570 and sample_size(0.2, 1.0) < 1570 and sample_size(0, 1.0) == sample_size(0.1, 0.0) == sample_size(float("nan"), 1.0) == -1


def test_interleaving(spark):
    top = lambda items: spark.createDataFrame([(u, 3, "v", x, n + 1) for u in range(200) for n, x in enumerate(items)], "user_id long, target long, vertical string, item_id long, place int")
    slates = interleave(top([1, 2, 3]), top([3, 4, 5]), k=3).collect()
    by_row: dict = {}
    for r in slates:
        by_row.setdefault(r.user_id, []).append(r.item_id)
    assert len(by_row) == 200 and all(len(x) == len(set(x)) == 3 for x in by_row.values())
    owners = [r.owner for r in slates if r.slot == 1]
    assert 60 < owners.count("a") < 140


def comparison(low, high, informative=100):
    return {"n": 200, "n_informative": informative, "rel_lift_pct": (low + high) / 2, "rel_ci_low": low, "rel_ci_high": high}


@pytest.mark.parametrize(("low", "high", "bar", "verdict"), [(0.1, 8.0, -0.02, "supported"), (-30, -12, -0.02, "refuted"), (-4.3, 2.1, 0.05, "refuted"), (-1, 12, 0.05, "inconclusive")])
def test_verdicts(low, high, bar, verdict):
    assert judge(comparison(low, high), bar)[0] == verdict
    assert judge(comparison(low, high, 29), bar)[0] == "underpowered"


def result(name, family, primary, coverage=0.5):
    return Evaluation(name, family, metrics={"ndcg_at_10": primary, "coverage_at_10": coverage})


def test_pruning_spares_arms_to_come():
    state = State({}, {r.model: r for r in (result("item_knn(k=150)", "item_knn", 0.0126), result("graph_walk(within,L=3)", "graph_walk", 0.0072), result("popularity", "popularity", 0.004))}, executed={"baselines"})
    prune(state)
    assert state.pruned == {"popularity"}
    state.executed |= {"cross_vertical_ablation", "graph_depth_and_kg"}
    prune(state)
    assert "graph_walk" in state.pruned


def test_planning():
    state = State({"multi_vertical_user_pct": 40.0, "median_history": 6, "has_sessions": True})
    assert plan_round(1, state, 4).actions == ["baselines"] and choose_actions(2, state)[0] == ["cross_vertical_ablation"]
    assert choose_actions(2, State({"multi_vertical_user_pct": 3.0}))[0] == ["sequential"]
    assert plan_round(2, state, 4, advisor=lambda *_: ["fusion", "nonsense", "sequential", "baselines"]).actions == ["fusion", "sequential"]
    assert plan_round(3, state, 4, advisor=lambda *_: 1 / 0).actions == ["sequential"] and plan_round(5, state, 4) is None
    assert "budget" in should_stop(state, 5, 4)
    state.history, state.executed = [0.2, 0.2], set(state.executed) | {"session_adaptation", "fusion"}
    assert "plateau" in should_stop(state, 4, 4)
    results = {r.model: r for r in (result("popularity", "popularity", 0.9), result("two_stage(2src,+transfer)", "two_stage", 0.3), result("two_stage(2src,no-transfer)", "two_stage", 0.2), result("sasrec(+vert)", "sasrec", 0.8), result("item_knn(k=150)", "item_knn", 0.1))}
    assert resolve("@best_two_stage", results) == resolve("two_stage(+transfer)", results) == "two_stage(2src,+transfer)"
    assert resolve("@best_retriever", results) == "item_knn(k=150)" and resolve("graph_walk", results) is None
    assert "CONFLICT" in reconcile({}, {"abs_lift": 0.1}, {"abs_lift": -0.1, "significant": True})[0]


def test_unknown_models():
    with pytest.raises(KeyError):
        build("magic")
    with pytest.raises(ValueError):
        build("two_stage")


def test_attention_gradients():
    rng = np.random.default_rng(1)
    p = {"E": rng.standard_normal((7, 4)), "P": rng.standard_normal((3, 4)), "V": rng.standard_normal((3, 4)), **{w: rng.standard_normal((4, 4)) for w in ("Wq", "Wk", "Wv")}}
    items, verticals, right, wrong = np.array([[0, 2, 3], [1, 4, 2]]), np.array([[0, 1, 2], [1, 1, 2]]), np.array([5, 6]), np.array([1, 3])
    _, g = gradients(p, items, verticals, right, wrong)
    for k, w in p.items():
        for _ in range(4):
            at = tuple(rng.integers(1 if k == "E" else 0, n) if i == 0 else rng.integers(0, n) for i, n in enumerate(w.shape))
            kept, loss = w[at], []
            for shift in (1e-6, -1e-6):
                w[at] = kept + shift
                loss.append(gradients(p, items, verticals, right, wrong)[0])
            w[at] = kept
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(g[k][at], rel=1e-3, abs=1e-7)
    h, _ = attend(p, items, verticals)
    assert h.shape == (2, 4)


def test_without_the_text_operators(tmp_path):
    """The rest imports and registers its queries where the llm folders and the pipeline, or only its operators, are gone."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lumora", tmp_path / "lumora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 50 and 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr


def test_both_ways_of_a_walk(spark, small, monkeypatch):
    """The walk over a broadcast graph and the walk of joins give the same scores and ranks."""
    rows, found = small.eval_rows(), []
    for edges in (walk.BROADCAST_EDGES, 0):
        monkeypatch.setattr(walk, "BROADCAST_EDGES", edges)
        model = walk.GraphWalk().fit(small)
        assert (model.graph is None) == (edges == 0)
        scores = {(r.user_id, r.item_id): round(r.score, 9) for r in model.score(rows).collect()}
        found.append((scores, {r.user_id: r["rank"] for r in model.rank(rows).collect()}, sorted(r[:] for r in model.top(rows).select("user_id", "item_id", "place").collect())))
    assert found[0] == found[1] and found[0][0]
