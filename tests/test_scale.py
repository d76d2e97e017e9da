"""Ways that larger tables take: the same results as the plain ways, without rows for each pair."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumora.models import bridge, fusion, walk
from lumora.models.neighbours import ItemNeighbours, Popularity
from lumora.operators.dataset import Dataset, build_dataset
from lumora.plans import registry


def values(df, *columns):
    rounded = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes) if not columns or c in columns]
    return sorted(tuple(r) for r in df.select(*rounded).collect())


@pytest.fixture(scope="module")
def camps(spark):
    """Three camps of users that share no item; in each, everyone has some of its nine items, of three verticals; the last event lies in any of them."""
    events = [(100 * c + u, 100 * c + (u * step + at * (step + u % 2)) % 9, at) for c in range(3) for u in range(24) for step in (1 + u % 4,) for at in range(5 + u % 4)]
    item = F.col("item_id")
    log = spark.createDataFrame(events, "user_id long, item_id long, ts long").withColumns({"vertical": F.concat(F.lit("v"), (item % 3).cast("string")), "session_id": F.col("ts"), "tiebreak": item})
    log = log.withColumn("ts", F.timestamp_seconds("ts"))
    items = log.select("item_id", "vertical").distinct().withColumns({"category": F.concat(F.lit("c"), (item % 4).cast("string")), "price_band": F.lit(1)})
    return build_dataset(log, items)


def test_parts(camps):
    assert {(r.item_id // 100, r.part // 100) for r in camps.parts.collect()} == {(c, c) for c in range(3)}
    assert camps.parts.select("part").distinct().count() == 3 and camps.parts.count() == camps.seen.select("item_id").distinct().count()


@pytest.mark.parametrize(("cross", "share"), [(True, 5), (False, 20_000)])
def test_walk_by_parts(camps, monkeypatch, cross, share):
    """A graph of more edges than are broadcast is walked part by part, with the scores of joins, whose states are a row for each user and node."""
    monkeypatch.setattr(walk, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(walk, "PART_ROWS", share)
    rows, model = camps.eval_rows(), walk.GraphWalk(use_metadata=False, cross_vertical=cross)
    with monkeypatch.context() as none:
        none.setattr(walk, "PART_EDGES", 0)
        joined = model.fit(camps)
        assert joined.cells is None
        want = [values(joined.score(rows)), values(joined.rank(rows), "user_id", "rank"), values(joined.top(rows, 2))]
    parted = walk.GraphWalk(use_metadata=False, cross_vertical=cross).fit(camps)
    parted._score_by_joins = None
    assert [values(parted.score(rows)), values(parted.rank(rows), "user_id", "rank"), values(parted.top(rows, 2))] == want
    assert want[0] and want[1] and want[2]


def test_bridge_by_groups(spark, camps, monkeypatch):
    """Candidates of a category and a popularity score alike: ranks, blends and the finite check need a row for each such group, not for each candidate."""
    data = Dataset(camps.events, camps.items.withColumn("category", F.when(F.col("item_id") % 9 != 8, F.col("category"))), 10)  # some have no category
    rows = data.eval_rows()
    with monkeypatch.context() as none:
        none.setattr(bridge, "BROADCAST_ITEMS", 0)
        plain = bridge.CategoryBridge().fit(data)
        assert plain.alike is None
        scores = values(plain.score(rows), "user_id", "target", "item_id", "score")
        ranks, mixed = values(plain.rank(rows), "user_id", "rank"), values(registry._blended_pairs(data, plain))
    monkeypatch.setattr(bridge, "expand", None)
    monkeypatch.setattr(registry.evaluate, "expand", None)
    model = bridge.CategoryBridge().fit(data)
    assert values(model.score(rows), "user_id", "target", "item_id", "score") == scores and values(model.rank(rows), "user_id", "rank") == ranks
    assert values(registry._blended(data)) == mixed and len(mixed) == 2 * rows.count()
    assert values(registry._nonfinite(data)) == [(0,)]
    bad = model.score_alike(model.with_values(rows)).withColumn("score", F.lit(float("nan")))
    assert values(registry.evaluate.check_finite(bad, "n")) == [(len(scores),)]


def test_dense_features_by_runs(spark, camps, monkeypatch):
    """Over one sparse retriever the candidates without a score lie in runs: no pair is shuffled or sorted; features, z-scores and negatives are the plain way's."""
    rows, stage = camps.eval_rows(), fusion.TwoStage([ItemNeighbours(4).fit(camps)], n_candidates=3)
    stage.data = camps
    columns = [*fusion.KEY, "item_id", *stage._columns()]
    got = [values(stage.features(rows).select(*columns)), values(stage.zscores(rows, 6)), values(stage.drawn(rows, 2, 3))]
    assert "Window" not in stage.zscores(rows, 6)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(fusion, "BROADCAST_ITEMS", 0)
    assert got == [values(stage.features(rows).select(*columns)), values(stage.zscores(rows, 6)), values(stage.drawn(rows, 2, 3))]
    assert any(r[columns.index("score0")] == 0 for r in stage.features(rows).select(*columns).collect()) and len(got[2]) == 5 * rows.count()


def test_pairs_are_dealt(camps, monkeypatch):
    """Few rows that meet many candidates are dealt to as many tasks as their pairs need."""
    rows, model = camps.eval_rows().coalesce(1), Popularity().fit(camps)
    whole = values(model.scores(rows))
    monkeypatch.setattr(registry.evaluate, "TASK_PAIRS", 50)
    dealt = model.scores(rows)
    assert dealt.rdd.getNumPartitions() >= len(whole) // 100 > 1 and values(dealt) == whole
