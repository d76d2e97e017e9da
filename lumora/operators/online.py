"""Split tests of slates: rows of logged slates and their clicks, or, as a check of the whole loop, slates served on a generated log whose true
utilities are known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.functions.stats import resampled_means, sample_size, two_sided
from lumora.operators.evaluate import KEY
from lumora.session import cut
from lumora.sources.simulator import Log, click_probability, uniform, utility


def serve(top_a: DataFrame, top_b: DataFrame, log: Log, k: int = 10, seed: int = 0) -> DataFrame:
    """(user_id, target, vertical, treated, clicks, ctr, slate_utility): each user, by a hash, sees one ranker's top k."""
    treated = uniform(F.col("user_id"), F.lit(seed), F.lit("arm")) < 0.5
    slates = top_a.where(treated).withColumn("treated", F.lit(True)).unionByName(top_b.where(~treated).withColumn("treated", F.lit(False)))
    pairs = slates.where(F.col("place") <= k).join(log.users.select("user_id", "taste", "own"), "user_id").join(log.items.select("item_id", "concept", "private"), "item_id")
    pairs = pairs.withColumn("utility", utility(pairs))
    click = uniform(*map(F.col, KEY), F.col("item_id"), F.lit(seed), F.lit("online")) < click_probability(F.col("utility"), F.col("place") - 1, log.settings)
    served = pairs.groupBy(*KEY, "treated").agg(F.sum(click.cast("int")).alias("clicks"), F.avg("utility").alias("slate_utility"))
    return served.withColumn("ctr", F.col("clicks") / k)


def split_test(top_a: DataFrame, top_b: DataFrame, log: Log, k: int = 10, seed: int = 0, daily_users: int = 200_000) -> dict:
    """a (treatment) against b (control) on a generated log."""
    return {"method": "simulated split test"} | slate_test(cut(serve(top_a, top_b, log, k, seed)), k, seed, daily_users)


def slate_test(served: DataFrame, k: int = 10, seed: int = 0, daily_users: int = 200_000) -> dict:
    """The treated slates against the others by clicks over k, unpaired: served(treated, clicks, slate_utility or not), a row a slate.

    What reaches the driver are the numbers of slates by arm and clicks, k + 1 an arm.
    """
    counts = served.groupBy("treated", "clicks").agg(F.count("*").alias("n")).collect()
    arms = {}
    for arm in (True, False):
        rows = sorted((r.clicks / k, r.n) for r in counts if r.treated == arm)
        arms[arm] = (np.array([x for x, _ in rows]), np.array([n for _, n in rows], np.int64))
    if not all(n.sum() for _, n in arms.values()):
        return {"error": "an arm has no user"}
    means = {arm: float(x @ n / n.sum()) for arm, (x, n) in arms.items()}
    lift = means[True] - means[False]
    interval = two_sided(resampled_means(*arms[True], seed=seed) - resampled_means(*arms[False], seed=seed + 1), lift)
    values, sizes = (np.concatenate([arms[True][i], arms[False][i]]) for i in (0, 1))
    pooled = float(np.sqrt(np.average((values - np.average(values, weights=sizes)) ** 2, weights=sizes)))
    known = F.avg("slate_utility") if "slate_utility" in served.columns else F.lit(None)
    worth = {r.treated: r.u for r in served.groupBy("treated").agg(known.alias("u")).collect()}
    needed = sample_size(lift, pooled)
    return {
        "metric": f"ctr_at_{k}", "control_mean": means[False], "treatment_mean": means[True], "abs_lift": lift, "rel_lift_pct": 100 * lift / means[False] if means[False] > 0 else float("nan"),
        "ci_low": interval.low, "ci_high": interval.high, "p_value": interval.p_value, "significant": interval.significant, "n_units": int(sizes.sum()), "required_n_per_arm": needed,
        "days_to_significance": round(2 * needed / daily_users, 2) if needed > 0 else None, "slate_utility_control": worth.get(False), "slate_utility_treatment": worth.get(True),
    }
