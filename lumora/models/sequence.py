"""A self-attentive sequence model, trained in rounds over all histories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.models.base import Recommender
from lumora.models.rounds import averaged, drawn, shares
from lumora.models.transformer import AdamW, encode, gradients, initial
from lumora.operators.dataset import Dataset
from lumora.operators.evaluate import KEY, expand
from lumora.operators.split import last_n
from lumora.session import cut, ship

REPLICA_EVENTS = 1 << 17  # events of a replica's histories, about
ROUNDS = 4
SPARE = 1000  # partitions beyond one for each replica, as hashes put some together
ENCODED = 512  # histories encoded at a time


def windows(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """[n, length]: one more than the positions before each end, as far back as its start, left-padded with 0."""
    at = ends[:, None] - np.arange(length, 0, -1)
    return np.where(at >= starts[:, None], at + 1, 0)


def _packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


class Attention(Recommender):
    """score = representation of the history . item embedding. stale leaves out each user's newest train event, as a representation
    does that was made before it; the session variant encodes all of them, and after them the items of a column session_prefix, where the
    rows have one; unknown items in it are left out. Users without a history score 0, items without train events -1e6.
    The network is transformer.py's; training asks each position for the next item, a batch being so many histories.

    Each round deals the users to replicas by hash; a replica gets its histories and their items' embeddings, draws its negatives from
    those items and trains; embeddings are averaged by their events, the other weights by the replicas' examples.
    """

    dense = True

    def __init__(
        self, d: int = 64, max_len: int = 50, lr: float = 0.001, epochs: int = 12, batch: int = 256, use_vertical: bool = True, stale: bool = True, seed: int = 0,
        replica_events: int = REPLICA_EVENTS, n_heads: int = 2, n_blocks: int = 2, dropout: float = 0.2, weight_decay: float = 1e-5,
    ):
        if d % n_heads:
            raise ValueError(f"{n_heads} heads can't share {d} components evenly")
        self.d, self.length, self.lr, self.epochs, self.batch, self.vertical, self.stale, self.seed = d, max_len, lr, epochs, batch, use_vertical, stale, seed
        self.replica_events, self.heads, self.blocks, self.dropout, self.decay = replica_events, n_heads, n_blocks, dropout, weight_decay

    @property
    def family(self) -> str:
        return "sasrec" if self.stale else "sasrec_session"

    @property
    def name(self) -> str:
        return f"{self.family}({'+vert' if self.vertical else 'no-vert'})"

    def fit(self, data: Dataset) -> Attention:
        self.data, kind = data, dict(data.seen.dtypes)["item_id"]
        ship(data.seen.sparkSession)
        self.verticals = sorted(r.vertical for r in data.train.select("vertical").distinct().collect() if r.vertical is not None) if self.vertical else []
        histories = cut(last_n(data.train, self.length + 1))
        items = cut(data.seen.select("item_id").distinct().select("item_id", drawn("item_id", self.d, 0.02, self.seed).alias("v")))
        n_replicas = -(-(histories.agg(F.sum(F.size("history"))).first()[0] or 0) // self.replica_events) or 1
        rng = np.random.default_rng(self.seed)
        self.p = {k: rng.normal(0, 0.02, (size, self.d)) for k, size in (("P", self.length), ("V", len(self.verticals) + 1))} | initial(self.d, self.blocks, rng)
        for turn, epochs in enumerate(shares(self.epochs, ROUNDS)):
            replica = F.pmod(F.xxhash64("user_id", F.lit(self.seed + turn)), F.lit(n_replicas)).alias("replica")
            asked = histories.select(replica, F.xxhash64("user_id").alias("place"), "history", F.lit(None).cast(kind).alias("item_id"), F.lit(None).cast("array<double>").alias("v"))
            needed = asked.select("replica", F.explode("history.item_id").alias("item_id")).distinct().join(items, "item_id")
            rows = asked.unionByName(needed.select("replica", F.lit(None).cast("long").alias("place"), F.lit(None).cast(asked.schema["history"].dataType).alias("history"), "item_id", "v"))
            rows = rows.repartition(n_replicas + min(3 * n_replicas, SPARE), "replica")  # a number of its own: small partitions would be put together, and replicas train one after another
            found = cut(rows.groupBy("replica").applyInArrow(self._trainer(turn, epochs), f"item_id {kind}, weight double, v array<double>"))
            items = cut(averaged(found.where("item_id is not null"), "item_id", self.d))
            self._take(found.where("item_id is null").select("weight", "v"))
        self.embeddings = items
        return self

    def _take(self, found: DataFrame) -> None:
        """The replicas' weights become their mean: each task adds up its own, and the driver gets one value for each weight of the model."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, total = 0.0, 0.0
            for batch in batches:
                for w, v in zip(batch.column("weight").to_numpy(), batch.column("v")):
                    weight, total = weight + w, total + w * v.values.to_numpy()
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total], pa.list_(pa.float64()))], ["weight", "v"])

        sums = found.mapInArrow(partial, "weight double, v array<double>").select("weight", F.posexplode("v").alias("at", "x"))
        mean = sums.groupBy("at").agg((F.sum("x") / F.sum("weight")).alias("x")).toArrow().sort_by("at")["x"].to_numpy()
        at = 0
        for k in sorted(self.p) if len(mean) else ():
            self.p[k], at = mean[at : at + self.p[k].size].reshape(self.p[k].shape), at + self.p[k].size

    def _trainer(self, turn: int, epochs: int):
        length, heads, lr, size, seed, verticals = self.length, self.heads, self.lr, self.batch, self.seed, pa.array(self.verticals, pa.string())
        dense, dropout, decay = self.p, self.dropout, self.decay

        def train(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            items, asked = table.filter(pc.is_valid(table["item_id"])).sort_by("item_id"), table.filter(pc.is_valid(table["place"])).sort_by("place")
            events = pc.list_flatten(asked["history"]).combine_chunks()
            known = np.append(0, pc.index_in(events.field("item_id"), value_set=items["item_id"].combine_chunks()).to_numpy() + 1)
            kinds = np.append(0, pc.index_in(events.field("vertical"), value_set=verticals).fill_null(-1).to_numpy() + 1)
            sizes = pc.list_value_length(asked["history"]).to_numpy()
            ends = np.cumsum(sizes)
            starts = ends - sizes
            longer = np.flatnonzero(sizes > 1)  # a history's first event is never the one to find
            p = {**dense, "E": np.vstack([np.zeros(dense["P"].shape[1]), np.stack(items["v"].to_numpy())])}
            p = {k: w.astype(np.float32) for k, w in p.items()}
            rng = np.random.default_rng([seed & 0xFFFFFFFF, turn, table["replica"][0].as_py()])
            optimizer = AdamW(lr, decay)
            for _ in range(epochs):
                order = rng.permutation(longer)
                for lo in range(0, len(order), size):
                    some = order[lo : lo + size]
                    at = windows(starts[some], ends[some] - 1, min(length, sizes[some].max() - 1))
                    right = known[np.where(at > 0, at + 1, 0)]
                    _, g = gradients(p, known[at], kinds[at], right, rng.integers(1, len(items) + 1, at.shape), heads, dropout, rng)
                    optimizer.step(p, g)
            p = {k: w.astype(float) for k, w in p.items()}
            used = np.bincount(known, minlength=len(items) + 1)[1:].astype(float)
            embedded = p.pop("E")[1:]
            ids = pa.concat_arrays([items["item_id"].combine_chunks(), pa.nulls(1, items["item_id"].type)])
            return pa.table({"item_id": ids, "weight": np.append(used, (sizes[longer] - 1).sum() or 1e-9), "v": pa.array([*embedded, _packed(p)], pa.list_(pa.float64()))})

        return train

    def _encoded(self, rows: DataFrame) -> DataFrame:
        """(user_id, target, vertical, h): the representation of each row that has a history."""
        asked = rows.select(*KEY, *(["session_prefix"] if "session_prefix" in rows.columns and not self.stale else []))
        asked = asked.join(last_n(self.data.train, self.length + 1), "user_id", "left")
        history = F.coalesce("history", F.array().cast(asked.schema["history"].dataType))
        if self.stale:
            history = F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0)))
        elif "session_prefix" in asked.columns:
            later = F.transform("session_prefix", lambda x: F.struct(x.alias("item_id"), F.col("vertical").alias("vertical")))
            history = F.concat(history, F.coalesce(later, F.array().cast(asked.schema["history"].dataType)))
        asked = asked.withColumn("history", history)
        events = asked.select(*KEY, F.posexplode("history").alias("at", "event")).withColumn("item_id", F.col("event.item_id")).join(self.embeddings, "item_id")
        entry = F.struct("at", F.col("event.vertical").alias("kind"), "v")
        grouped = events.groupBy(*KEY).agg(F.sort_array(F.collect_list(entry)).alias("events"))
        length, heads, dense, verticals = self.length, self.heads, self.p, pa.array(self.verticals, pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("events")
                events, ends = column.flatten(), np.cumsum(pc.list_value_length(column).to_numpy())
                vectors = events.field("v").flatten().to_numpy().reshape(len(events), -1)
                p = {**dense, "E": np.vstack([np.zeros(dense["P"].shape[1]), vectors])}
                kinds = np.append(0, pc.index_in(events.field("kind"), value_set=verticals).fill_null(-1).to_numpy() + 1)
                starts, h = np.append(0, ends)[:-1], []
                for lo in range(0, len(ends), ENCODED):
                    part = slice(lo, lo + ENCODED)
                    at = windows(starts[part], ends[part], min(length, (ends - starts)[part].max()))
                    h.extend(encode(p, at, kinds[at], heads)[0][:, -1])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(h, pa.list_(pa.float64()))], [*KEY, "h"])

        types = dict(rows.dtypes)
        return grouped.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in KEY), "h array<double>"]))

    def score(self, rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        encoded, items = self._encoded(rows), self.embeddings.withColumn("_known", F.lit(True))
        pairs = expand(rows, self.data).join(items, "item_id", "left").join(encoded, list(KEY), "left")
        dot = F.aggregate(F.zip_with("h", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return pairs.select(*KEY, "item_id", F.when(F.col("_known").isNull(), F.lit(-1e6)).otherwise(F.coalesce(dot, F.lit(0.0))).alias("score"))
