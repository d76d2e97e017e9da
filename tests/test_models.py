"""Models that are trained in rounds: all data take part, however they are dealt."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.models.catalog import build
from lumora.models.factor import PairwiseFactors
from lumora.models.rounds import averaged, shares
from lumora.models.sequence import Attention, windows
from lumora.models.transformer import encode, gradients, initial
from lumora.models.walk import attributes
from lumora.operators.dataset import Dataset
from lumora.sources.catalog import load


@pytest.fixture(scope="module")
def camps(spark):
    """40 users in two camps; a camp's users walk round its own six items, starting anywhere, and their next one is the target."""
    events = [(u, f"{'ab'[u % 2]}{(u + t) % 6}", "v", t, "test" if t == 5 else "train") for u in range(40) for t in range(6)]
    log = spark.createDataFrame([(*e[:4], e[0], (e[3],), e[4]) for e in events], "user_id long, item_id string, vertical string, ts long, session_id long, tiebreak struct<a:int>, part string")
    items = spark.createDataFrame([(f"{c}{i}", "v", "v:a", 1) for c in "ab" for i in range(6)], "item_id string, vertical string, category string, price_band int")
    return Dataset(log, items)


def own_camp(model, rows):
    """How often a user's best item is one of their own camp, with all scores finite and a score for each candidate."""
    found = model.score(rows).collect()
    assert len(found) == 40 * 12 and np.isfinite([r.score for r in found]).all()
    best: dict = {}
    for r in found:
        best[r.user_id] = max(best.get(r.user_id, (-9e9, "")), (r.score, r.item_id))
    return np.mean([item[0] == "ab"[u % 2] for u, (_, item) in best.items()])


@pytest.mark.parametrize("sizes", [(1 << 17, 1 << 20), (7, 60)])
def test_pairwise_factors_in_cells(spark, camps, sizes):
    model = PairwiseFactors(factors=6, epochs=60, block_items=sizes[0], cell_pairs=sizes[1]).fit(camps)
    assert model.user_factors.count() == 40 and model.item_factors.count() == 12
    assert own_camp(model, camps.eval_rows()) > 0.9


def test_pairwise_factors_repeat(spark, camps):
    fit = lambda: {r.user_id: r.u for r in PairwiseFactors(factors=3, epochs=1, cell_pairs=60).fit(camps).user_factors.collect()}
    first, second = fit(), fit()
    assert all(np.allclose(u, second[k]) for k, u in first.items())


@pytest.mark.parametrize("replica", [1 << 17, 60])
def test_attention_in_replicas(spark, camps, replica):
    model = Attention(d=8, max_len=4, lr=0.02, epochs=80, batch=16, stale=False, replica_events=replica, n_heads=1, n_blocks=1, dropout=0).fit(camps)
    assert model.embeddings.count() == 12
    assert own_camp(model, camps.eval_rows()) > 0.9


def test_a_session_prefix_is_a_longer_history(spark, camps):
    rows = camps.eval_rows()
    model = Attention(d=8, max_len=4, epochs=2, stale=False).fit(camps)
    plain = {(r.user_id, r.item_id): r.score for r in model.score(rows).collect()}
    empty = {(r.user_id, r.item_id): r.score for r in model.score(rows.withColumn("session_prefix", F.lit(None).cast("array<string>"))).collect()}
    more = {(r.user_id, r.item_id): r.score for r in model.score(rows.withColumn("session_prefix", F.array(F.lit("a1"), F.lit("nowhere")))).collect()}
    assert plain == empty and plain != more
    # the newest four events of user 0 are then a2, a3, a4 and a1; the unknown item is left out
    at = {r.item_id: np.array(r.v) for r in model.embeddings.collect()}
    p = {**model.p, "E": np.array([np.zeros(8), at["a2"], at["a3"], at["a4"], at["a1"]])}
    h = encode(p, np.array([[1, 2, 3, 4]]), np.ones((1, 4), int), 2)[0][0, -1]
    assert all(more[0, i] == pytest.approx(h @ v) for i, v in at.items())


def test_the_newest_event_is_left_out_when_stale(spark, camps):
    rows, model = camps.eval_rows(), Attention(d=4, max_len=4, epochs=1).fit(camps)
    assert {r.user_id for r in model._encoded(rows).collect()} == set(range(40))
    one = rows.where("user_id = 0").withColumn("user_id", F.lit(99).cast("long"))  # nobody's history
    assert {r.score for r in model.score(one).collect()} == {0.0}


def test_windows_shares_and_means(spark):
    assert windows(np.array([0, 3]), np.array([2, 4]), 3).tolist() == [[0, 1, 2], [0, 0, 4]]
    assert shares(30, 6) == [5] * 6 and shares(2, 4) == [1, 1] and shares(0, 4) == []
    found = averaged(spark.createDataFrame([("a", 1.0, [1.0, 0.0]), ("a", 3.0, [5.0, 4.0])], "k string, weight double, v array<double>"), "k", 2)
    assert found.first().v == [4.0, 3.0]


def test_permuted_features(spark, camps):
    rows = camps.eval_rows()
    camps_val = Dataset(camps.events.unionByName(camps.events.where("part = 'test'").withColumn("part", F.lit("val"))), camps.items)
    model = build("two_stage", {"max_iter": 3, "max_depth": 2}, [build("item_knn").fit(camps_val)]).fit(camps_val)
    drops = model.permutation_importances(rows, n_rows=20, n_negatives=4, repeats=1)
    assert {c for c, _ in drops} == set(model._columns()) and [d for _, d in drops] == sorted((d for _, d in drops), reverse=True)
    assert dict(drops)["hist_total"] == pytest.approx(0) and drops[0][1] > 0


def test_categories_of_rating_files(spark, tmp_path):
    """Rating files to a dataset: low ratings go, and items that the same users take share a category within their vertical."""
    for vertical in "xy":
        rows = [f"u{u},{vertical}{'ab'[u % 2]}{(u + t) % 6},{5.0 if t < 6 else 1.0},{1_600_000_000_000 + 1000 * t}" for u in range(40) for t in range(7)]
        (tmp_path / f"{vertical}.csv").write_text("\n".join(["user_id,parent_asin,rating,timestamp", *rows]))
    data = load(spark, "ratings", paths={v: f"{tmp_path}/{v}.csv" for v in "xy"}, min_item_count=1, rank=2)  # the camps are all that two factors can tell apart
    found = {r.item_id: (r.vertical, r.category) for r in data.items.collect()}
    assert len(found) == 24 and data.events.count() == 480 and "price_band" not in data.items.columns
    assert {(item[0], c) for item, (_, c) in found.items()} == {("x", "c0"), ("x", "c1"), ("y", "c2"), ("y", "c3")}
    assert len({(item[:2], c) for item, (_, c) in found.items()}) == 4
    assert {r.attribute.split("=")[0] for r in attributes(data).collect()} == {"category", "vertical"}


@pytest.fixture
def small():
    """(weights of two blocks, histories, verticals) with padding and one history that is padding alone."""
    rng = np.random.default_rng(3)
    p = {k: w + rng.normal(0, 0.2, w.shape) for k, w in initial(6, 2, rng).items()}
    p |= {k: rng.normal(0, 0.5, (size, 6)) for k, size in {"E": 8, "P": 5, "V": 3}.items()}
    p["E"][0] = 0
    return p, np.array([[0, 1, 2, 3], [4, 5, 4, 6], [0, 0, 0, 2], [0, 0, 0, 0]]), np.array([[0, 1, 2, 1], [2, 2, 1, 1], [0, 0, 0, 2], [0, 0, 0, 0]])


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients_against_differences(small, dropout):
    p, items, kinds = small
    right, wrong = np.array([[0, 2, 3, 7], [5, 4, 6, 1], [0, 0, 0, 3], [0, 0, 0, 0]]), np.array([[1, 6, 6, 1], [2, 2, 3, 7], [1, 4, 2, 6], [1, 1, 2, 3]])
    loss = lambda: gradients(p, items, kinds, right, wrong, 2, dropout, np.random.default_rng(8))
    _, g = loss()
    assert set(g) == set(p)
    for name, w in p.items():
        for at in [*np.ndindex(*w.shape)][::3]:
            if name == "E" and at[0] == 0:
                continue  # padding isn't learnt
            found = []
            for step in (1e-5, -2e-5):
                w[at] += step
                found.append(loss()[0])
            w[at] += 1e-5
            assert g[name][at] == pytest.approx((found[0] - found[1]) / 2e-5, abs=1e-7)


def test_a_position_depends_on_its_own_past_alone(small):
    p, items, kinds = small
    h, _ = encode(p, items, kinds, 2)
    later = items.copy()
    later[1, 3] = 1
    changed, _ = encode(p, later, kinds, 2)
    assert np.array_equal(h[1, :3], changed[1, :3]) and not np.allclose(h[1, 3], changed[1, 3])
    short, _ = encode(p, items[:1, 1:], kinds[:1, 1:], 2)  # more padding changes nothing
    assert np.allclose(h[0, 1:], short[0]) and np.isfinite(h).all()


def test_blocks_against_a_plain_version(small):
    """One history position by position and head by head, with loops."""
    p, items, kinds = small
    norm = lambda x, w, b: (x - x.mean()) / np.sqrt(x.var() + 1e-5) * p[w] + p[b]
    xs = [p["E"][i] * np.sqrt(6) + p["P"][t + 1] + p["V"][k] for t, (i, k) in enumerate(zip(items[1], kinds[1]))]
    for b in (0, 1):
        ys = [norm(x, f"gain_attend{b}", f"bias_attend{b}") for x in xs]
        after = []
        for t, x in enumerate(xs):
            heads = []
            for part in (slice(0, 3), slice(3, 6)):
                q = ys[t] @ p[f"query{b}"][:, part]
                a = np.exp([q @ (y @ p[f"key{b}"][:, part]) / np.sqrt(3) for y in ys[: t + 1]])
                heads.append(sum(w * (y @ p[f"value{b}"][:, part]) for w, y in zip(a / a.sum(), ys)))
            x = x + np.concatenate(heads) @ p[f"out{b}"]
            u = norm(x, f"gain_inner{b}", f"bias_inner{b}") @ p[f"up{b}"] + p[f"up_bias{b}"]
            after.append(x + (0.5 * u * (1 + np.tanh(np.sqrt(2 / np.pi) * (u + 0.044715 * u**3)))) @ p[f"down{b}"] + p[f"down_bias{b}"])
        xs = after
    assert np.allclose(encode(p, items, kinds, 2)[0][1], [norm(x, "gain", "bias") for x in xs])
    with pytest.raises(ValueError, match="share 6 components"):
        Attention(d=6, n_heads=4)


def test_two_heads_and_blocks_in_replicas(spark, camps):
    model = Attention(d=8, max_len=4, lr=0.02, epochs=80, batch=16, stale=False, replica_events=60, dropout=0.1).fit(camps)
    assert model.embeddings.count() == 12
    assert own_camp(model, camps.eval_rows()) > 0.9
