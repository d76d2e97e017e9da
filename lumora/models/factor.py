"""Latent factors: pairwise ranking in rounds over blocks of users and items, and alternating least squares of Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.models.base import Recommender
from lumora.models.rounds import averaged, drawn, shares
from lumora.operators.dataset import Dataset
from lumora.operators.evaluate import KEY, expand
from lumora.session import cut, ship

BLOCK_ITEMS = 1 << 17  # items of a cell, about
CELL_PAIRS = 1 << 20  # user-item pairs of a cell, about
ROUNDS = 6


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


class FactorModel(Recommender):
    """Scores u . v + bias from user_factors(user_id, u) and item_factors(item_id, v, bias); unknown users score 0."""

    family = "bpr_mf"
    dense = True

    def score(self, rows: DataFrame) -> DataFrame:
        pairs = expand(rows, self.data).join(self.item_factors, "item_id", "left").join(self.user_factors, "user_id", "left")
        return pairs.select(*KEY, "item_id", F.coalesce(_dot("u", "v") + F.col("bias"), F.lit(0.0)).alias("score"))


def descend(users: np.ndarray, items: np.ndarray, a: np.ndarray, b: np.ndarray, epochs: int, lr: float, reg: float, batch: int, rng: np.random.Generator) -> np.ndarray:
    """Adam on -log sigmoid(x_ab - x_ac) for the pairs (a, b) and uniform items c, in place; returns how often each item was touched.

    The last component of an item is its bias.
    """
    p, d = [users, items], users.shape[1]
    m, v, step, touched = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0, np.zeros(len(items))
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            u, i, j = a[at], b[at], rng.integers(0, len(items), len(at))
            apart = items[i] - items[j]
            pull = (1 / (1 + np.exp((users[u] * apart[:, :d]).sum(axis=1) + apart[:, d])) / len(at))[:, None]
            towards = np.hstack([users[u], np.ones((len(at), 1))])
            decay = np.append(np.full(d, reg), 0) / len(at)
            grads = [np.zeros_like(users), np.zeros_like(items)]
            np.add.at(grads[0], u, -pull * apart[:, :d] + reg * users[u] / len(at))
            np.add.at(grads[1], i, -pull * towards + decay * items[i])
            np.add.at(grads[1], j, pull * towards + decay * items[j])
            np.add.at(touched, np.concatenate([i, j]), 1)
            step += 1
            for x, g, first, second in zip(p, grads, m, v, strict=True):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                x -= lr * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return touched


class PairwiseFactors(FactorModel):
    """-log sigmoid(x_ui - x_uj) over uniform negatives j, by Adam on minibatches, over all pairs.

    Each round deals users and items to blocks by hash, anew; a task trains on the pairs of a block of users with a block of items, whose
    negatives come from that block; factors are averaged by the number of their pairs. A small log is one cell, trained as a whole.
    """

    def __init__(self, factors: int = 64, lr: float = 0.05, reg: float = 2e-5, epochs: int = 30, batch: int = 8192, seed: int = 0, block_items: int = BLOCK_ITEMS, cell_pairs: int = CELL_PAIRS):
        self.factors, self.lr, self.reg, self.epochs, self.batch, self.seed = factors, lr, reg, epochs, batch, seed
        self.block_items, self.cell_pairs = block_items, cell_pairs

    @property
    def name(self) -> str:
        return f"bpr_mf(d={self.factors})"

    def fit(self, data: Dataset) -> PairwiseFactors:
        self.data, d, kinds = data, self.factors, dict(data.seen.dtypes)
        ship(data.seen.sparkSession)
        users = cut(data.seen.select("user_id").distinct().select("user_id", drawn("user_id", d, 0.05, self.seed).alias("v")))
        start = F.concat(drawn("item_id", d, 0.05, self.seed), F.array(F.lit(0.0)))
        items = cut(data.seen.select("item_id").distinct().select("item_id", start.alias("v")))
        n_blocks = -(-items.count() // self.block_items) or 1
        n_cells = -(-data.seen.count() // (self.cell_pairs * n_blocks)) or 1
        schema = f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, weight double, v array<double>"
        for turn, epochs in enumerate(shares(self.epochs, ROUNDS)):
            block = F.pmod(F.xxhash64("item_id", F.lit(self.seed + turn)), F.lit(n_blocks)).alias("block")
            cell = F.pmod(F.xxhash64("user_id", F.lit(self.seed + turn)), F.lit(n_cells)).alias("cell")
            lists = data.seen.groupBy("user_id", block).agg(F.collect_list("item_id").alias("items"))
            asked = lists.join(users, "user_id").select(cell, "block", "user_id", F.lit(None).cast(kinds["item_id"]).alias("item_id"), "items", "v")
            offered = items.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cells - 1).cast("long"))).alias("cell"), block, F.lit(None).cast(kinds["user_id"]).alias("user_id"), "item_id", F.lit(None).cast(f"array<{kinds['item_id']}>").alias("items"), "v")
            found = cut(asked.unionByName(offered).groupBy("cell", "block").applyInArrow(self._trainer(turn, epochs), schema))
            users = cut(averaged(found.where("user_id is not null"), "user_id", d))
            items = cut(averaged(found.where("item_id is not null"), "item_id", d + 1))
        self.user_factors = users.withColumnRenamed("v", "u")
        self.item_factors = items.select("item_id", F.slice("v", 1, d).alias("v"), F.col("v")[d].alias("bias"))
        return self

    def _trainer(self, turn: int, epochs: int):
        lr, reg, batch, seed = self.lr, self.reg, self.batch, self.seed

        def train(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            users, items = table.filter(pc.is_valid(table["user_id"])).sort_by("user_id"), table.filter(pc.is_valid(table["item_id"])).sort_by("item_id")
            vectors = [np.stack(x["v"].to_numpy()) if len(x) else np.zeros((0, 1)) for x in (users, items)]
            sizes, touched = np.zeros(0, np.int64), np.zeros(len(items))
            if len(users):
                sizes = pc.list_value_length(users["items"]).to_numpy()
                a, b = np.repeat(np.arange(len(users)), sizes), pc.index_in(pc.list_flatten(users["items"]), value_set=items["item_id"].combine_chunks()).to_numpy()
                order = np.lexsort((b, a))
                rng = np.random.default_rng([seed & 0xFFFFFFFF, turn, table["cell"][0].as_py(), table["block"][0].as_py()])
                touched = descend(*vectors, a[order], b[order], epochs, lr, reg, batch, rng)
            weight = np.concatenate([sizes, np.maximum(touched, 1e-9)]).astype(float)  # an item no pair touches stays as it is
            ids = pa.concat_tables([users.select(["user_id", "item_id"]), items.select(["user_id", "item_id"])])
            rows = [*vectors[0][: len(users)], *vectors[1][: len(items)]]
            return pa.table({"user_id": ids["user_id"], "item_id": ids["item_id"], "weight": weight, "v": pa.array(rows, pa.list_(pa.float64()))})

        return train


class LeastSquaresFactors(FactorModel):
    """Implicit alternating least squares of Spark: another loss than the pairwise one, and the one that scales with the log."""

    def __init__(self, factors: int = 64, reg: float = 0.05, alpha: float = 10.0, epochs: int = 10, seed: int = 0):
        self.factors, self.reg, self.alpha, self.epochs, self.seed = factors, reg, alpha, epochs, seed

    @property
    def name(self) -> str:
        return f"als(d={self.factors})"

    def fit(self, data: Dataset) -> LeastSquaresFactors:
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.recommendation import ALS

        self.data = data
        pairs = data.seen.withColumns({"us": F.col("user_id").cast("string"), "its": F.col("item_id").cast("string"), "one": F.lit(1.0)})
        index = StringIndexer(inputCols=["us", "its"], outputCols=["un", "in"], stringOrderType="alphabetAsc").fit(pairs)
        pairs = index.transform(pairs)
        model = ALS(rank=self.factors, regParam=self.reg, alpha=self.alpha, maxIter=self.epochs, implicitPrefs=True, userCol="un", itemCol="in", ratingCol="one", seed=self.seed).fit(pairs.select("un", "in", "one"))
        users, items = pairs.select("user_id", F.col("un").cast("int").alias("id")).distinct(), pairs.select("item_id", F.col("in").cast("int").alias("id")).distinct()
        self.user_factors = model.userFactors.join(users, "id").select("user_id", F.col("features").alias("u"))
        self.item_factors = model.itemFactors.join(items, "id").select("item_id", F.col("features").alias("v"), F.lit(0.0).alias("bias"))
        return self
