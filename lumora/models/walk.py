"""Random walks with restart over items and their attributes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.columns import half_life
from lumora.models.base import Recommender
from lumora.models.neighbours import cooccurrence, strongest
from lumora.operators.dataset import Dataset
from lumora.operators.evaluate import KEY, unmasked_sizes, with_seen
from lumora.session import cut, ship

BROADCAST_EDGES = 10_000_000  # so many edges of 20 bytes at most are broadcast; beyond that the walk is joins
WALK_ROWS = 32  # evaluation rows whose scores leave a task together
PART_EDGES = 2_000_000  # edges of a part of the graph that a task holds, at most
PART_ROWS = 20_000  # evaluation rows that walk a part in one task, about


def share(edges: DataFrame, source: str = "src", weight: str = "w") -> DataFrame:
    """The edges with each source's weights scaled to a sum of 1."""
    return edges.withColumn(weight, F.col(weight) / F.greatest(F.sum(weight).over(Window.partitionBy(source)), F.lit(1e-9)))


def item_edges(data: Dataset, top_k: int = 150) -> DataFrame:
    """(src, dst, w): co-occurrence over the roots of both popularities, top_k a source, shares of each source."""
    roots = data.popularity.select("item_id", F.sqrt(F.greatest("pop", F.lit(1))).alias("root"))
    pairs = cooccurrence(data.seen.join(roots, "item_id"), "root")
    pairs = pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.round(F.col("co") / (F.col("root_i") * F.col("root_j")), 12).alias("w"))
    return share(strongest(pairs, "src", "w", "dst", top_k))


def attributes(data: Dataset) -> DataFrame:
    """(item_id, attribute): category, price band and vertical of each item, as tagged strings; columns that the items lack give none."""
    tags = F.array(*(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("category", "price_band", "vertical") if c in data.items.columns))
    return data.items.select("item_id", F.explode(F.array_compact(tags)).alias("attribute"))


def graph_edges(data: Dataset, top_k: int = 150, use_metadata: bool = True, meta_weight: float = 0.35) -> DataFrame:
    """(src, dst, w) over nodes as strings; meta_weight is the share of an item's outgoing mass that goes to attributes."""
    items = item_edges(data, top_k)
    node = lambda c: F.concat(F.lit("item="), F.col(c).cast("string"))
    if not use_metadata:
        return items.select(node("src").alias("src"), node("dst").alias("dst"), "w")
    links = attributes(data).select(node("item_id").alias("item"), "attribute", F.lit(1.0).alias("w"))
    out = share(links, "item").select(F.col("item").alias("src"), F.col("attribute").alias("dst"), (F.col("w") * meta_weight).alias("w"))
    back = share(links, "attribute").select(F.col("attribute").alias("src"), F.col("item").alias("dst"), "w")
    return items.select(node("src").alias("src"), node("dst").alias("dst"), (F.col("w") * (1 - meta_weight)).alias("w")).unionByName(out).unionByName(back)


class GraphWalk(Recommender):
    """The states of walk_length steps of state = (1 - restart) * state * T + restart * seed, summed.

    The seed is the history on the ranked vertical plus transfer_weight times the history elsewhere, each a distribution of its
    events; the walk is linear, so one walk carries both. Without cross_vertical the second part is left out.
    """

    family = "graph_walk"

    def __init__(self, walk_length: int = 3, restart: float = 0.25, cross_vertical: bool = True, transfer_weight: float = 0.6, use_metadata: bool = True, cooc_top_k: int = 150, recency_halflife: float = 0.0, meta_weight: float = 0.35):
        self.length, self.restart, self.transfer = walk_length, restart, transfer_weight if cross_vertical else 0.0
        self.cross, self.metadata, self.top_k, self.halflife, self.meta_weight = cross_vertical, use_metadata, cooc_top_k, recency_halflife, meta_weight

    @property
    def name(self) -> str:
        return f"graph_walk({'xvert' if self.cross else 'within'}{'+kg' if self.metadata else ''},L={self.length})"

    def fit(self, data: Dataset) -> GraphWalk:
        self.data = data
        self.edges = cut(graph_edges(data, self.top_k, self.metadata, self.meta_weight))
        return self

    def seeds(self, rows: DataFrame) -> DataFrame:
        """(user_id, vertical, node, w) for the users and verticals of rows; repeated events count."""
        age = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("tiebreak"))) - 1
        train = self.data.train.withColumn("w", half_life(age, self.halflife)).select("user_id", F.col("vertical").alias("own"), F.concat(F.lit("item="), F.col("item_id").cast("string")).alias("node"), "w")
        asked = rows.select("user_id", "vertical").distinct()
        parts = asked.join(train, "user_id").groupBy("user_id", "vertical", (F.col("own") == F.col("vertical")).alias("inside"), "node").agg(F.sum("w").alias("w"))
        mass = F.sum("w").over(Window.partitionBy("user_id", "vertical", "inside"))
        weighed = parts.withColumn("w", F.col("w") / F.greatest(mass, F.lit(1e-9)) * F.when(F.col("inside"), 1.0).otherwise(self.transfer))
        return weighed.where("w > 0").groupBy("user_id", "vertical", "node").agg(F.sum("w").alias("w"))

    def score(self, rows: DataFrame) -> DataFrame:
        if self.graph is None and self.cells is None:
            return self._score_by_joins(rows)
        return self._walked(rows.select(*KEY), _all_scores)

    def rank(self, rows: DataFrame) -> DataFrame:
        """Ranked where the walk ends, so that no score leaves its task."""
        if self.graph is None and self.cells is None:
            return super().rank(rows)
        ranked = self._walked(with_seen(rows.select(*KEY), self.data), _own_rank).select(*KEY, F.col("score").cast("long").alias("rank"))
        return unmasked_sizes(rows, self.data).join(ranked, list(KEY), "left").withColumn("rank", F.coalesce("rank", "n_open")).drop("n_open")

    def top(self, rows: DataFrame, k: int = 10) -> DataFrame:
        if self.graph is None and self.cells is None:
            return super().top(rows, k)
        best = self._walked(with_seen(rows.select(*KEY), self.data), partial(_best, k=k))
        return best.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "item_id")))

    @cached_property
    def graph(self) -> Broadcast | None:
        """The numbered edges, broadcast; None where there are more than BROADCAST_EDGES. An item's edges are top_k and its attributes."""
        if self.edges.limit(BROADCAST_EDGES + 1).count() > BROADCAST_EDGES:
            return None
        nodes = self.nodes
        numbered = self.edges.join(nodes.toDF("src", "i"), "src").join(nodes.toDF("dst", "j"), "dst").select("i", "j", "w").toArrow()
        pool = self.data.candidates.select(F.concat(F.lit("item="), F.col("item_id").cast("string")).alias("node"), "vertical", "item_id").join(nodes, "node")
        found, pools = pool.select("vertical", "number", "item_id").toArrow(), {}
        for v in found.column("vertical").unique().to_pylist():
            mine = found.filter(pc.equal(found.column("vertical"), v)).sort_by("item_id")
            pools[v] = (mine.column("number").to_numpy(), mine.column("item_id").combine_chunks())
        return self.edges.sparkSession.sparkContext.broadcast(Graph(nodes.count(), *(numbered.column(c).to_numpy() for c in ("i", "j", "w")), pools))

    @cached_property
    def nodes(self) -> DataFrame:
        """(node, number) of the graph's nodes, candidates and items; only called for graphs that can be broadcast."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("node")).union(self.data.items.select(F.concat(F.lit("item="), F.col("item_id").cast("string"))))
        return cut(ends.distinct().withColumn("number", F.row_number().over(Window.orderBy("node")) - 1))

    @cached_property
    def cells(self) -> DataFrame | None:
        """(part, item_id, vertical of a candidate, ends, shares) of each item: the graph by its parts (`Dataset.parts`), which no walk leaves.

        None where attributes tie all items together, or a part has more than PART_EDGES edges.
        """
        if self.metadata or self.data.parts is None:
            return None
        kind = dict(self.data.items.dtypes)["item_id"]
        item = lambda c: F.regexp_replace(c, "^item=", "").cast(kind)
        out = self.edges.groupBy("src").agg(F.collect_list("dst").alias("ends"), F.collect_list("w").alias("shares"))
        out = out.select(item("src").alias("item_id"), F.transform("ends", item).alias("ends"), "shares")
        found = cut(self.data.parts.join(self.data.candidates.select("item_id", "vertical"), "item_id", "left").join(out, "item_id", "left").select("part", "item_id", "vertical", "ends", "shares"))
        return found if found.groupBy("part").agg(F.sum(F.size("ends")).alias("n")).where(F.col("n") > PART_EDGES).isEmpty() else None

    def _walked_by_parts(self, rows: DataFrame, finish: Callable) -> DataFrame:
        """The same for a graph of more edges than are broadcast: each part's items go to the tasks of its rows, ahead of them."""
        spark = rows.sparkSession
        ship(spark)
        seeds = self.seeds(rows).withColumn("item_id", F.regexp_replace("node", "^item=", "").cast(dict(self.cells.dtypes)["item_id"])).join(self.data.parts, "item_id")
        seeds = seeds.groupBy("user_id", "vertical").agg(F.min("part").alias("part"), F.collect_list("item_id").alias("nodes"), F.collect_list("w").alias("weights"))
        asked = cut(rows.join(seeds, ["user_id", "vertical"]))  # all train items of a user lie in one part
        shares = cut(asked.groupBy("part").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_shares")))
        items = self.cells.join(shares, "part").withColumns({"_share": F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)), "_row": F.lit(False)}).drop("_shares")
        asked = asked.join(shares, "part").withColumns({"_share": F.pmod(F.xxhash64(*KEY), F.col("_shares")).cast("int"), "_row": F.lit(True)}).drop("_shares")
        both = items.unionByName(asked, allowMissingColumns=True)
        dealt = both.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "_share").sortWithinPartitions("part", "_share", "_row")
        length, restart = self.length, self.restart
        return dealt.mapInArrow(lambda batches: _walk_parts(batches, length, restart, finish), self._walked_schema(rows))

    def _walked_schema(self, rows: DataFrame) -> str:
        kinds = dict(rows.dtypes)
        return ", ".join([*(f"{k} {kinds[k]}" for k in KEY), f"item_id {dict(self.data.candidates.dtypes)['item_id']}", "score double"])

    def _walked(self, rows: DataFrame, finish: Callable) -> DataFrame:
        """(KEY, item_id, score): what `finish` keeps of each row's candidates."""
        if self.graph is None:
            return self._walked_by_parts(rows, finish)
        spark = rows.sparkSession
        ship(spark)
        seeds = self.seeds(rows).join(self.nodes, "node").groupBy("user_id", "vertical").agg(F.collect_list("number").alias("nodes"), F.collect_list("w").alias("weights"))
        asked = rows.join(seeds, ["user_id", "vertical"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
        graph, length, restart = self.graph, self.length, self.restart
        return asked.mapInArrow(lambda batches: _walk(batches, graph, length, restart, finish), self._walked_schema(rows))

    def _score_by_joins(self, rows: DataFrame) -> DataFrame:
        """The same as joins of states with edges, for graphs of any size. The last step keeps only what ends on a candidate of the
        vertical; each step cuts its lineage."""
        seeds = cut(self.seeds(rows))
        pool = self.data.candidates.select(F.concat(F.lit("item="), F.col("item_id").cast("string")).alias("node"), "vertical", "item_id")
        again = seeds.withColumn("w", F.col("w") * self.restart)
        state, total = seeds, None
        for step in range(self.length):
            edges, on = self.edges.toDF("node", "dst", "t"), ["node"]
            if step == self.length - 1:
                edges, on = edges.join(pool.select(F.col("node").alias("dst"), "vertical"), "dst"), ["node", "vertical"]
            moved = state.join(edges, on).select("user_id", "vertical", F.col("dst").alias("node"), (F.col("w") * F.col("t") * (1 - self.restart)).alias("w"))
            state = cut(moved.unionByName(again).groupBy("user_id", "vertical", "node").agg(F.sum("w").alias("w")))
            total = state if total is None else total.unionByName(state)
        scored = total.join(pool, ["node", "vertical"]).groupBy("user_id", "vertical", "item_id").agg(F.sum("w").alias("score"))
        return rows.select(*KEY).join(scored, ["user_id", "vertical"]).select(*KEY, "item_id", "score")


class Graph:
    """Numbered edges by source and by end, and each vertical's candidates (numbers, items)."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, pools: dict):
        self.n, self.pools = n, pools
        order = np.lexsort((j, i))
        self.first, self.ends, self.shares = np.searchsorted(i[order], np.arange(n + 1)), j[order].astype(np.int32), w[order]
        self._into: dict = {}

    def into(self, vertical):
        """(sources, shares, where each candidate's edges begin, candidates that have any) of the edges into a vertical's candidates;
        into all nodes for None."""
        if vertical not in self._into:
            i = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.first))
            place = np.full(self.n, -1)
            place[self.pools[vertical][0] if vertical is not None else np.arange(self.n)] = np.arange(len(self.pools[vertical][0]) if vertical is not None else self.n)
            to = place[self.ends]
            order = np.argsort(to, kind="stable")[np.count_nonzero(to < 0) :]
            at, begin = np.unique(to[order], return_index=True)
            self._into[vertical] = i[order], self.shares[order], begin, at
        return self._into[vertical]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_into": {}}

    def step(self, state: np.ndarray, vertical=None) -> np.ndarray:
        """state * T, for a state over all nodes; only over a vertical's candidates if it is given."""
        some = np.flatnonzero(state)
        if vertical is None and len(some) * 8 < self.n:
            counts = self.first[some + 1] - self.first[some]
            at = np.repeat(self.first[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            return np.bincount(self.ends[at], np.repeat(state[some], counts) * self.shares[at], self.n)
        sources, shares, begin, to = self.into(vertical)
        out = np.zeros(self.n if vertical is None else len(self.pools[vertical][0]))
        if len(begin):
            out[to] = np.add.reduceat(state[sources] * shares, begin)
        return out

    def walk(self, nodes: np.ndarray, weights: np.ndarray, vertical, length: int, restart: float) -> np.ndarray:
        """The summed states of the walk at the vertical's candidates."""
        seed = np.bincount(nodes, weights, self.n)
        state, mine = seed, self.pools[vertical][0]
        total = np.zeros(len(mine))
        for step in range(length):
            if step < length - 1:
                state = (1 - restart) * self.step(state) + restart * seed
                total += state[mine]
            else:
                total += (1 - restart) * self.step(state, vertical) + restart * seed[mine]
        return total


def _open(scores: np.ndarray, masked: np.ndarray, own: int) -> np.ndarray:
    """Where candidates have a score and aren't masked; the target, own, never is."""
    hidden = np.zeros(len(scores), bool)
    hidden[masked] = True
    if own >= 0:
        hidden[own] = False
    return np.flatnonzero((scores > 0) & ~hidden)


def _all_scores(scores: np.ndarray, masked: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    some = np.flatnonzero(scores)
    return some, scores[some]


def _own_rank(scores: np.ndarray, masked: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The target with its rank as score; nothing if it has no positive score."""
    if own < 0 or scores[own] <= 0:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.array([own]), np.array([np.count_nonzero(scores[_open(scores, masked, own)] >= scores[own])], float)


def _best(scores: np.ndarray, masked: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    some = _open(scores, masked, own)
    if len(some) > k:  # only what isn't below the k-th is sorted
        some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
    best = some[np.argsort(-scores[some], kind="stable")[:k]]
    return best, scores[best]


def _walk(batches: Iterator[pa.RecordBatch], shared: Broadcast, length: int, restart: float, finish: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _walk_batch(batch, shared.value, length, restart, finish)


def _walk_parts(batches: Iterator[pa.RecordBatch], length: int, restart: float, finish: Callable) -> Iterator[pa.RecordBatch]:
    """Items (rows with _row false) of a part, then the rows that walk it, part after part."""
    held, graph, items, current = [], None, None, None
    for batch in batches:
        keys = np.stack([batch.column("part").dictionary_encode().indices.to_numpy(), batch.column("_share").to_numpy(), batch.column("_row").cast(pa.int8()).to_numpy()])
        starts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            some = batch.slice(lo, hi - lo)
            if not some.column("_row")[0].as_py():
                key = some.column("part")[0], some.column("_share")[0]
                held, graph, current = [*(held if key == current else []), some], None, key
                continue
            if graph is None:
                graph, items = _part(pa.Table.from_batches(held))
            yield from _walk_batch(_numbered(some, items), graph, length, restart, finish)


def _part(table: pa.Table) -> tuple[Graph, pa.Array]:
    """The graph of a part's items, numbered in their order, and the items."""
    table = table.sort_by("item_id").combine_chunks()
    items, ends = table.column("item_id").combine_chunks(), table.column("ends").combine_chunks()
    degrees = pc.fill_null(pc.list_value_length(ends), 0).to_numpy()
    verticals, pools = table.column("vertical").combine_chunks(), {}
    for v in pc.unique(verticals.drop_null()).to_pylist():
        mine = np.flatnonzero(pc.fill_null(pc.equal(verticals, v), False).to_numpy(zero_copy_only=False))
        pools[v] = (mine, items.take(pa.array(mine)))
    to = pc.index_in(pc.list_flatten(ends), items).to_numpy()
    return Graph(len(items), np.repeat(np.arange(len(items)), degrees), to, pc.list_flatten(table.column("shares").combine_chunks()).to_numpy(), pools), items


def _numbered(rows: pa.RecordBatch, items: pa.Array) -> pa.RecordBatch:
    """The rows with their nodes as numbers."""
    nodes = rows.column("nodes")
    numbers = pc.index_in(pc.list_flatten(nodes), items)
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(nodes).to_numpy())]).astype(np.int32)
    return rows.set_column(rows.schema.get_field_index("nodes"), "nodes", pa.ListArray.from_arrays(pa.array(offsets), numbers))


def _places(wanted: pa.Array, verticals: list, graph: Graph) -> np.ndarray:
    """The place of each wanted item among its vertical's candidates, -1 if it isn't one: one lookup a vertical for all rows of a batch."""
    found = np.full(len(wanted), -1)
    for v in dict.fromkeys(verticals):
        mine = np.flatnonzero([x == v for x in verticals])
        if v in graph.pools:
            found[mine] = pc.fill_null(pc.index_in(wanted.take(pa.array(mine)), graph.pools[v][1]), -1).to_numpy()
    return found


def _walk_batch(batch: pa.RecordBatch, graph: Graph, length: int, restart: float, finish: Callable) -> Iterator[pa.RecordBatch]:
    verticals = batch.column("vertical").to_pylist()
    own = _places(batch.column("target"), verticals, graph)
    seen = batch.column("seen") if "seen" in batch.schema.names else pa.array([[]] * batch.num_rows, pa.list_(batch.column("target").type))
    sizes = pc.list_value_length(seen).to_numpy()
    known = _places(pc.list_flatten(seen), [v for v, n in zip(verticals, sizes.tolist(), strict=True) for _ in range(n)], graph)
    known = np.split(known, np.cumsum(sizes)[:-1])
    for lo in range(0, batch.num_rows, WALK_ROWS):
        items, scores, times = [], [], []
        for row in range(lo, min(lo + WALK_ROWS, batch.num_rows)):
            vertical = verticals[row]
            if vertical not in graph.pools:  # none of its candidates can be reached
                times.append(0)
                continue
            found = graph.walk(*(batch.column(c)[row].values.to_numpy() for c in ("nodes", "weights")), vertical, length, restart)
            if not np.isfinite(found).all():
                raise ValueError("non-finite score")
            kept, values = finish(np.round(found, 10) if finish is not _all_scores else found, known[row][known[row] >= 0], own[row])
            items.append(graph.pools[vertical][1].take(pa.array(kept)))
            scores.append(values)
            times.append(len(values))
        if items:
            rows = pa.array(np.repeat(np.arange(lo, lo + len(times)), times))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in KEY), pa.concat_arrays(items), pa.array(np.concatenate(scores))], [*KEY, "item_id", "score"])
