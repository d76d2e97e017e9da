"""Draws, samples, resampling by buckets, logged split tests, and rows that meet candidates in blocks, against plain versions."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.functions.draws import bucket, coin, digest
from lumora.functions.stats import bootstrap
from lumora.operators import compare, evaluate, exposure, sampling
from lumora.operators.online import slate_test
from lumora.plans import registry
from lumora.sources.ratings import read_ratings, write_ratings
from lumora.streaming.sessions import drained, files_as_stream, live_popularity

SF = "/root/testdata/sf0.001"
SCORED = "user_id long, target long, vertical string, item_id long, score double"


@pytest.fixture(scope="module")
def data(spark):
    return registry._data(spark, SF)


def md5(*parts, seed=0):
    return hashlib.md5("|".join(map(str, (*(p for p in parts if p is not None), seed))).encode()).hexdigest()


def test_draws_are_digests(spark):
    rows = [(1, "a"), (2, None), (None, "b|c"), (None, None)]
    found = spark.createDataFrame(rows, "x long, y string").select("x", "y", digest("x", "y", seed=3).alias("d"), coin("x", "y").alias("c"), bucket(200, "x", "y").alias("b")).collect()
    for r in found:
        assert r.d == md5(r.x, r.y, seed=3)
        assert (r.c, r.b) == (md5(r.x, r.y) < "8", int(md5(r.x, r.y)[:7], 16) % 200)
    many = spark.range(20_000).select(coin("id").alias("c")).agg(F.avg(F.col("c").cast("int"))).first()[0]
    assert 0.48 < many < 0.52


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_rows_meet_all_candidates(spark, data, monkeypatch, most):
    monkeypatch.setattr(evaluate, "BROADCAST_ITEMS", most)
    monkeypatch.setattr(evaluate, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(evaluate, "ROW_SALTS", 3)
    rows = data.eval_rows()
    found = evaluate.expand(rows, data, keep=("hist_len",))
    assert found.columns[:4] == ["vertical", "user_id", "target", "hist_len"] and "_salt" not in found.columns
    pool = defaultdict(list)
    for r in data.candidates.collect():
        pool[r.vertical].append(r.item_id)
    want = Counter((r.user_id, r.target, r.hist_len, i) for r in rows.collect() for i in pool[r.vertical])
    assert Counter((r.user_id, r.target, r.hist_len, r.item_id) for r in found.collect()) == want


def test_evaluation_rows_are_computed_once(data):
    assert data.eval_rows() is data.eval_rows("test") is not data.eval_rows("val")


def test_negatives(spark):
    rng = np.random.default_rng(5)
    rows = [(u, u % 7, "v", i, float(rng.integers(0, 4))) for u in range(12) for i in range(30)] + [(50, 0, "v", i, 0.0) for i in range(3)]
    frame = spark.createDataFrame(rows, SCORED).repartition(4)
    found = {}
    for r in sampling.negatives(frame, F.col("score"), n_hard=3, n_easy=5, pool=8, seed=2).collect():
        found.setdefault(r.user_id, set()).add((r.item_id, r.hard))
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u and r[3] != r[1]]
        drawn = lambda rs, u=u: sorted(rs, key=lambda r: (md5(u, r[1], "v", r[3], seed=2), r[3]))
        hard = drawn(sorted(own, key=lambda r: (-r[4], r[3]))[:8])[:3]
        easy = drawn([r for r in own if r not in hard])[:5]
        assert found[u] == {(r[3], True) for r in hard} | {(r[3], False) for r in easy}
    assert sampling.negatives(frame.limit(0), F.col("score"), 3, 5).count() == 0


def test_negatives_with_targets(spark):
    frame = spark.createDataFrame([(1, 3, "v", i, float(i)) for i in range(6)], SCORED)
    found = sampling.negatives(frame, F.col("score"), 2, 1, pool=3, targets=True).collect()
    assert [r.item_id for r in found if r.hard is None] == [3] and len(found) == 4 and {r.item_id for r in found if r.hard} < {2, 4, 5}


def test_rows_by_vertical(spark):
    rows = spark.range(1000).selectExpr("id as user_id", "id % 5 as target", "if(id % 3 = 0, 'a', if(id < 4, 'b', 'c')) as vertical")
    found = sampling.rows_by_vertical(rows, 20, seed=1)
    assert {r.vertical: r["count"] for r in found.groupBy("vertical").count().collect()} == {"a": 20, "b": 2, "c": 20}
    assert found.exceptAll(sampling.rows_by_vertical(rows.repartition(7), 20, seed=1)).isEmpty()


def paired_rows(spark, n=3000):
    rng = np.random.default_rng(8)
    rows = [(int(u), float(x), float(y)) for u, x, y in zip(rng.integers(0, 900, n), rng.random(n) + 0.03, rng.random(n), strict=True)]
    return spark.createDataFrame(rows, "user_id long, x double, y double"), rows


def test_replicates_resample_users(spark):
    frame, rows = paired_rows(spark)
    found = {r.replicate: r for r in compare.replicates(frame, 50, 40, seed=4).collect()}
    sums = defaultdict(lambda: np.zeros(3))
    for u, x, y in rows:
        sums[int(md5(u, "bucket", seed=4)[:7], 16) % 50] += (1, x - y, y)
    for r in range(40):
        n, d, y = sum(sums[int(md5(i, "draw", seed=4)[:7], 16) % 50] for i in range(r * 50, r * 50 + 50))
        assert found[r].n == n and found[r].delta == pytest.approx(d / n) and found[r].baseline == pytest.approx(y / n)


def test_replicates_agree_with_rows(spark):
    """Where users have one row, buckets and rows give about the same interval."""
    rng = np.random.default_rng(9)
    values = rng.normal(0.02, 0.3, 20_000)
    frame = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(values)], "user_id long, x double, y double")
    by_bucket = compare.replicate_interval(compare.replicates(frame)).first()
    by_row = bootstrap(values, np.ones(len(values)))
    assert by_bucket.ci_low == pytest.approx(by_row.low, abs=0.0015) and by_bucket.ci_high == pytest.approx(by_row.high, abs=0.0015)
    assert by_bucket.significant and by_bucket.rel_ci_low is None and by_bucket.n_replicates == compare.REPLICATES


def test_compare_with_many_values(spark, monkeypatch):
    frame, _ = paired_rows(spark)
    rows = frame.select("user_id", F.monotonically_increasing_id().alias("target"), F.lit("v").alias("vertical"), "x", "y")
    arms = [rows.select("user_id", "target", "vertical", F.col(c).alias("ndcg_at_10")) for c in "xy"]
    exact = compare.compare(*arms)
    monkeypatch.setattr(compare, "MAX_VALUES", 10)
    by_bucket = compare.compare(*arms)
    assert by_bucket["delta"] == exact["delta"] and by_bucket["ci_low"] < by_bucket["delta"] < by_bucket["ci_high"]
    assert by_bucket["ci_low"] == pytest.approx(exact["ci_low"], abs=0.01) and by_bucket["significant"] == exact["significant"]


LOG = "user_id long, day int, clicks double, views double"


def measured(spark, rows):
    log = spark.createDataFrame(rows, LOG)
    found = exposure.units(log, F.col("user_id") % 2 == 0, F.col("clicks"), F.col("views"), F.col("day") > 10)
    return found, exposure.arms(found), exposure.split_result(exposure.arms(found))


def test_split_test_of_a_log(spark):
    rng = np.random.default_rng(6)
    rows = []
    for u in range(3000):
        rate = rng.random() * 0.5
        for day in (5, 6, 15, 16):
            views = int(rng.integers(1, 20))
            lifted = rate * (1.2 if u % 2 == 0 and day > 10 else 1.0)
            rows.append((u, day, float(rng.binomial(views, lifted)), float(views)))
    units, arms, result = measured(spark, rows)
    x, y, p = (defaultdict(float) for _ in range(3))
    for u, day, c, v in rows:
        (x if day > 10 else p)[u] += c
        y[u] += v if day > 10 else 0
    r, by_arm = result.first(), {a.treated: a for a in arms.collect()}
    for arm in (True, False):
        own = [u for u in x if (u % 2 == 0) == arm]
        cov = np.cov([[x[u] for u in own], [y[u] for u in own], [p[u] for u in own]])
        assert by_arm[arm].n == len(own) and by_arm[arm].cov_xy == pytest.approx(cov[0, 1]) and by_arm[arm].cov_pp == pytest.approx(cov[2, 2])
    ratio = lambda users: sum(x[u] for u in users) / sum(y[u] for u in users)
    even, odd = [u for u in x if u % 2 == 0], [u for u in x if u % 2]
    assert r.lift == pytest.approx(ratio(even) - ratio(odd)) and r.significant and r.ci_low > 0 and r.chi_square == 0
    boot = [ratio(rng.choice(even, len(even))) - ratio(rng.choice(odd, len(odd))) for _ in range(300)]
    assert (r.ci_high - r.ci_low) / 3.92 == pytest.approx(np.std(boot), rel=0.15)
    sides = [np.array([[x[u], p[u]] for u in own]) for own in (even, odd)]
    within = sum((len(s) - 1) * np.cov(s.T) for s in sides)
    theta = within[0, 1] / within[1, 1]
    left = [(s[:, 0] - theta * s[:, 1]).var(ddof=1) / len(s) for s in sides]
    assert r.adjusted_delta == pytest.approx((sides[0][:, 0] - theta * sides[0][:, 1]).mean() - (sides[1][:, 0] - theta * sides[1][:, 1]).mean())
    assert r.adjusted_se == pytest.approx(np.sqrt(sum(left))) and r.variance_removed == pytest.approx(1 - sum(left) / sum(s[:, 0].var(ddof=1) / len(s) for s in sides))


def test_split_test_edge_cases(spark):
    rows = [(None, 15, 1.0, 1.0), (2, 15, None, 4.0), (2, 15, 1.0, None), (1, 5, 3.0, 3.0)]  # user 1 isn't shown while the test runs
    units, arms, result = measured(spark, rows)
    assert [tuple(r) for r in units.collect()] == [(2, True, 1.0, 4.0, 0.0)]
    assert arms.count() == 1 and arms.first().cov_xx == 0
    r = result.first()
    assert r.n_treated == 1 and r.n_control is None and r.lift is None and r.significant is None
    assert measured(spark, [])[1].count() == 0 and measured(spark, [])[2].first().lift is None
    none = measured(spark, [(u, 15, 0.0, 0.0) for u in range(10)])[2].first()
    assert none.ratio_treated is None and none.chi_square == 0


def test_logged_slates(spark):
    rows = [(u, u % 2 == 0, 3 if u % 2 == 0 and u % 3 else 1) for u in range(600)]
    found = slate_test(spark.createDataFrame(rows, "user_id long, treated boolean, clicks int"), k=10)
    assert found["treatment_mean"] == pytest.approx(np.mean([c for _, t, c in rows if t]) / 10) and found["control_mean"] == pytest.approx(0.1)
    assert found["significant"] and found["n_units"] == 600 and found["slate_utility_control"] is None
    assert slate_test(spark.createDataFrame(rows[:1], "user_id long, treated boolean, clicks int"))["error"]


def test_rating_files(spark, tmp_path):
    rows = [("a", "u", "i", 4.0, 1_700_000_000_000, "x"), ("a", "u", "j", 3.9, 1, "x"), ("b", "w", "i", 5.0, 2, None)]
    frame = spark.createDataFrame(rows, "vertical string, user_id string, parent_asin string, rating double, timestamp long, title string")
    paths = write_ratings(frame, f"{tmp_path}/r")
    assert set(paths) == {"a", "b"}
    assert sorted((r.user_id, r.item_id, r.vertical, r.tiebreak.timestamp) for r in read_ratings(spark, paths).collect()) == [("u", "i", "a", 1_700_000_000_000), ("w", "i", "b", 2)]


@pytest.mark.parametrize("folder", [True, False])
def test_a_stream_of_files(spark, tmp_path, folder):
    rows = [(1, "a", "v", "2024-01-01 01:00:00"), (2, "a", "v", "2024-01-01 05:00:00"), (1, "b", "v", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "user_id long, item_id string, vertical string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/in" if folder else str(next((tmp_path / "in").glob("*.parquet")))
    found = drained(live_popularity(files_as_stream(spark, path))).collect()
    assert [(r.vertical, r.item_id, r.n) for r in found] == [("v", "a", 2)]  # the last day is still open
