"""A dataset: the split log and what every model and measure derives from it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.columns import gini, percent_rank_average
from lumora.operators.split import MIN_USER_EVENTS, frequent, leave_one_out, referenced
from lumora.schema import ATTRIBUTES, EVENTS, ITEMS, require
from lumora.session import cut

MAX_CANDIDATES = 3000
PART_ROUNDS = 16  # rounds that the search for parts may take
COLD_EVENTS = 2
TAIL = 0.70


@dataclass
class Dataset:
    """events carry the part (train, val, test, or null: a held-out item unknown to train); items have events.

    seen, popularity, candidates and the evaluation rows are computed once, as tables: every model and measure reads them.
    """

    events: DataFrame
    items: DataFrame
    max_candidates: int = MAX_CANDIDATES
    log: Any = None
    _rows: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False, compare=False)

    @cached_property
    def train(self) -> DataFrame:
        return self.events.where("part = 'train'")

    @cached_property
    def seen(self) -> DataFrame:
        """(user_id, item_id) of train, once each: the user-item matrix."""
        return cut(self.train.select("user_id", "item_id").distinct())

    @cached_property
    def parts(self) -> DataFrame | None:
        """(item_id, part): train items that are tied by users who have both, directly or along a chain, share a part, named by its smallest
        item; None where chains are too long for PART_ROUNDS rounds. All train items of a user lie in one part."""
        labels = self.seen.groupBy("item_id").agg(F.first("item_id").alias("part"))
        for _ in range(PART_ROUNDS):
            users = self.seen.join(labels, "item_id").groupBy("user_id").agg(F.min("part").alias("part"), F.collect_list(F.struct("item_id", F.col("part").alias("old"))).alias("had"))
            told = users.select("part", F.explode("had").alias("item")).groupBy(F.col("item.item_id").alias("item_id")).agg(F.min("part").alias("part"), F.first("item.old").alias("old"))
            told = cut(told)
            labels = told.select("item_id", "part")
            if told.where("part <> old").isEmpty():
                return labels
        return None

    @cached_property
    def popularity(self) -> DataFrame:
        """(item_id, vertical, pop): distinct users in train, 0 where there are none."""
        users = self.seen.groupBy("item_id").agg(F.count("*").alias("pop"))
        return cut(self.items.select("item_id", "vertical").join(users, "item_id", "left").withColumn("pop", F.coalesce("pop", F.lit(0))))

    @cached_property
    def n_candidates(self) -> int:
        return self.candidates.count()

    @cached_property
    def candidates(self) -> DataFrame:
        """(item_id, vertical, pop): the most popular of each vertical and all held-out targets."""
        by_pop = Window.partitionBy("vertical").orderBy(F.desc("pop"), "item_id")
        top = self.popularity.withColumn("_place", F.row_number().over(by_pop)).where(F.col("_place") <= self.max_candidates).drop("_place")
        targets = self.events.where("part in ('test', 'val')").select("item_id")
        forced = self.popularity.join(targets, "item_id", "left_semi")
        return cut(top.union(forced).distinct())

    def eval_rows(self, part: str = "test") -> DataFrame:
        """A row for each held-out target whose user has a history: user_id, target, vertical, history counts and slice flags."""
        if part not in self._rows:
            self._rows[part] = cut(self._eval_rows(part))
        return self._rows[part]

    def _eval_rows(self, part: str) -> DataFrame:
        rows = self.events.where(F.col("part") == part).select("user_id", F.col("item_id").alias("target"), "vertical")
        history = self.train.groupBy("user_id").agg(F.count("*").alias("hist_len"), F.count_distinct("vertical").alias("n_hist_verticals"))
        inside = self.train.groupBy("user_id", "vertical").agg(F.count("*").alias("in_vertical_hist"))
        ranks = percent_rank_average(self.popularity, "pop", "target_pop_pct").select(F.col("item_id").alias("target"), "target_pop_pct")
        rows = rows.join(history, "user_id").join(inside, ["user_id", "vertical"], "left").join(ranks, "target")
        rows = rows.withColumn("in_vertical_hist", F.coalesce("in_vertical_hist", F.lit(0)))
        cold, cross = F.col("in_vertical_hist") <= COLD_EVENTS, F.col("n_hist_verticals") >= 2
        return rows.select(
            "user_id", "target", "vertical", "hist_len", "n_hist_verticals", "in_vertical_hist", cold.alias("cold_in_vertical"), cross.alias("cross_vertical_user"),
            (cold & cross).alias("transfer_only"), "target_pop_pct", (F.col("target_pop_pct") < TAIL).alias("tail_target"),
        )

    def vertical_counts(self, verticals: list[str]) -> DataFrame:
        """(user_id, one column a vertical): train events, 0 where there are none."""
        return self.train.groupBy("user_id").pivot("vertical", verticals).count().fillna(0)

    def profile(self) -> DataFrame:
        """One row of summary figures of the log."""
        users = self.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("vertical").alias("v"), F.count_distinct("session_id").alias("s"))
        sizes = users.agg(
            F.count("*").alias("n_users"), F.sum("n").alias("n_events"), F.floor(F.median("n")).cast("long").alias("median_history"),
            F.round(100 * F.avg((F.col("v") >= 2).cast("double")), 1).alias("multi_vertical_user_pct"), (F.max("s") > 1).alias("has_sessions"),
        )
        items = self.items.agg(F.count("*").alias("n_items"))
        shares = gini(self.popularity, "pop").select(F.round("gini", 6).alias("gini"))
        rows = self.eval_rows().agg(F.count("*").alias("eval_rows"), *(F.round(100 * F.avg(F.col(c).cast("double")), 1).alias(f"pct_{c}") for c in ("cold_in_vertical", "transfer_only")))
        out = sizes.crossJoin(items).crossJoin(shares).crossJoin(rows)  # one row each
        return out.withColumn("density", F.round(F.try_divide(F.col("n_events").cast("double"), F.col("n_users") * F.col("n_items")), 8))


def build_dataset(events: DataFrame, items: DataFrame, min_user_events: int = MIN_USER_EVENTS, max_candidates: int = MAX_CANDIDATES) -> Dataset:
    """Checks the columns, keeps users with enough events and items and events that refer to one another, and splits."""
    events, items = frequent(require(events, EVENTS, "the log"), "user_id", min_user_events), require(items, ITEMS, "the item table", ATTRIBUTES)
    events, items = referenced(events, items)
    return Dataset(cut(leave_one_out(events)), cut(items), max_candidates)
