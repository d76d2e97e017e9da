"""Popularity and item neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.columns import half_life
from lumora.models.base import Recommender
from lumora.operators.dataset import Dataset
from lumora.operators.evaluate import KEY, expand
from lumora.session import cut


def cooccurrence(seen: DataFrame, value: str | None = None) -> DataFrame:
    """(i, j, co) with i <> j: users who have both items in train. value: a column of the items in seen, which each end brings along."""
    own = [value] if value else []
    a, b = (seen.select("user_id", F.col("item_id").alias(end), *(F.col(v).alias(f"{v}_{end}") for v in own)) for end in "ij")
    ends, turned = (["i", "j", *(f"{v}_{end}" for v in own for end in order)] for order in ("ij", "ji"))
    turned = [F.col("j").alias("i"), F.col("i").alias("j"), *(F.col(x).alias(y) for x, y in zip(turned[2:], ends[2:], strict=True))]
    once = a.join(b, "user_id").where("i < j").groupBy(*ends).agg(F.count("*").alias("co"))
    return once.select(F.explode(F.array(F.struct(*ends), F.struct(*turned))).alias("pair"), "co").select(*(f"pair.{x}" for x in ends), "co")


def strongest(edges: DataFrame, source: str, weight: str, other: str, k: int) -> DataFrame:
    """The k heaviest edges of each source, ties by the other end."""
    best = Window.partitionBy(source).orderBy(F.desc(weight), other)
    return edges.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).drop("_place")


class Popularity(Recommender):
    family = "popularity"
    dense = True

    def __init__(self, damping: bool = False):
        self.damping = damping

    @property
    def name(self) -> str:
        return "popularity"

    def fit(self, data: Dataset) -> Popularity:
        self.data = data
        return self

    def score(self, rows: DataFrame) -> None:
        """None: log damping keeps the order, so the ranks come from the counts."""
        return

    def scores(self, rows: DataFrame) -> DataFrame:
        """The scores one by one, where something needs their values."""
        value = F.log1p("pop") if self.damping else F.col("pop").cast("double")
        return expand(rows, self.data, pool=self.data.candidates.select("vertical", "item_id", value.alias("score"))).select(*KEY, "item_id", "score")


class ItemNeighbours(Recommender):
    """Similarity co / ((sqrt(n_i) + shrink) * (sqrt(n_j) + shrink)), the top_k of each history item; a score sums them over the history.

    With a half life, history items weigh 0.5 ** (age / half life), age 0 at the newest event, repeats added up.
    """

    family = "item_knn"

    def __init__(self, top_k: int = 200, shrink: float = 10.0, recency_halflife: float = 0.0):
        self.top_k, self.shrink, self.halflife = top_k, shrink, recency_halflife

    @property
    def name(self) -> str:
        return f"item_knn(k={self.top_k})"

    def fit(self, data: Dataset) -> ItemNeighbours:
        self.data = data
        norms = data.popularity.select("item_id", (F.sqrt("pop") + self.shrink).alias("norm"))
        pairs = cooccurrence(data.seen.join(norms, "item_id"), "norm")  # the norms meet the user-item pairs, which are fewer than the item pairs
        pairs = pairs.select("i", "j", F.round(F.col("co") / (F.col("norm_i") * F.col("norm_j")), 12).alias("similarity"))
        self.similarity = cut(strongest(pairs, "i", "similarity", "j", self.top_k))
        return self

    def history(self) -> DataFrame:
        """(user_id, i, weight) of train."""
        if not self.halflife:
            return self.data.seen.select("user_id", F.col("item_id").alias("i"), F.lit(1.0).alias("weight"))
        age = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("tiebreak"))) - 1
        weighed = self.data.train.withColumn("weight", half_life(age, self.halflife))
        return weighed.groupBy("user_id", F.col("item_id").alias("i")).agg(F.sum("weight").alias("weight"))

    def score(self, rows: DataFrame) -> DataFrame:
        history = self.history().join(rows.select("user_id").distinct(), "user_id", "left_semi")
        items = self.data.candidates.select(F.col("item_id").alias("j"), "vertical")
        scored = history.join(self.similarity.join(items, "j"), "i").groupBy("user_id", "vertical", F.col("j").alias("item_id")).agg(F.sum(F.col("weight") * F.col("similarity")).alias("score"))
        return rows.select(*KEY).join(scored, ["user_id", "vertical"]).select(*KEY, "item_id", "score")
