"""Ranking evaluation: the seen mask, pessimistic ranks, metrics by slice, top lists, the leaderboard.

Scores are long: (user_id, target, vertical, item_id, score). Sparse scores leave out zeros; a target without a score ranks
behind every candidate that isn't masked. An item that the user has in train is masked, unless it is the target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.columns import hit, ndcg
from lumora.operators.dataset import Dataset
from lumora.session import cut

KS = (5, 10, 20)
METRICS = tuple(f"{m}_at_{k}" for k in KS for m in ("hit", "ndcg"))
PRIMARY = "ndcg_at_10"
MIN_SLICE = 30
KEY = ("user_id", "target", "vertical")
BROADCAST_ITEMS = 1_000_000  # candidates that are broadcast, at most
BLOCK_ITEMS = 5_000  # beyond that, candidates of a block
ROW_SALTS = 64  # and the shares that a vertical's rows are dealt to
TASK_PAIRS = 4_000_000  # rows with candidates that a task makes, about


def slices() -> dict[str, tuple[str | None, Column]]:
    """name -> (the column it needs, the condition)."""
    return {
        "all": (None, F.lit(True)),
        "cold_in_vertical": ("cold_in_vertical", F.col("cold_in_vertical")),
        "warm_in_vertical": ("cold_in_vertical", ~F.col("cold_in_vertical")),
        "transfer_only": ("transfer_only", F.col("transfer_only")),
        "single_vertical_user": ("cross_vertical_user", ~F.col("cross_vertical_user")),
        "tail_target": ("tail_target", F.col("tail_target")),
    }


def spread(rows: DataFrame, data: Dataset, counted: DataFrame | None = None) -> DataFrame:
    """rows dealt to so many tasks that each makes about TASK_PAIRS rows with candidates: few bytes, much work. counted: as many rows, cheaper to count."""
    verticals = max(1, data.candidates.select("vertical").distinct().count())
    n = (rows if counted is None else counted).count() * data.n_candidates // verticals // TASK_PAIRS
    return rows.repartition(n) if n > 1 else rows


def expand(rows: DataFrame, data: Dataset, keep: Sequence[str] = (), pool: DataFrame | None = None) -> DataFrame:
    """Every evaluation row (the key and the columns `keep`) with every candidate of its vertical: for models whose scores are dense.

    pool: the candidates with other columns. Verticals are few, so rows never meet candidates by vertical alone: BROADCAST_ITEMS
    candidates at most are sent to the rows where they are; beyond, rows meet blocks of BLOCK_ITEMS candidates, and each
    vertical's rows are dealt to ROW_SALTS tasks a block.
    """
    rows, pool = rows.select(*KEY, *keep), data.candidates if pool is None else pool
    if data.n_candidates <= BROADCAST_ITEMS:
        return spread(rows, data).join(F.broadcast(pool), "vertical")
    blocks = pool.withColumn("_block", F.floor(F.row_number().over(Window.partitionBy("vertical").orderBy("item_id")) / BLOCK_ITEMS).cast("int"))
    last = blocks.groupBy("vertical").agg(F.max("_block").alias("_last"))  # a row a vertical
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ROW_SALTS - 1))))
    placed = rows.join(F.broadcast(last), "vertical").withColumn("_block", F.explode(F.sequence(F.lit(0), "_last"))).withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(ROW_SALTS)).cast("int"))
    return placed.join(salted, ["vertical", "_block", "_salt"]).drop("_block", "_salt", "_last")


def mask_seen(scores: DataFrame, data: Dataset) -> DataFrame:
    """The scores without the items that the user has in train, except for the target."""
    seen = data.seen.withColumn("_seen", F.lit(True))
    masked = scores.join(seen, ["user_id", "item_id"], "left")
    return masked.where("_seen is null or item_id = target").drop("_seen")


def check_finite(scores: DataFrame, n: str | None = None) -> DataFrame:
    """(n_bad): how many scores are null, NaN or infinite. n: a column of how many candidates have a row's score."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return scores.agg(F.coalesce(F.sum(bad.cast("long") * (F.col(n) if n else F.lit(1))), F.lit(0)).alias("n_bad"))


def guarded(scores: DataFrame) -> DataFrame:
    """The scores; a job that meets a non-finite one fails."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return scores.withColumn("score", F.when(bad, F.raise_error(F.lit("non-finite score")).cast("double")).otherwise(F.round("score", 10)))


def unmasked_sizes(rows: DataFrame, data: Dataset, hidden: str | None = None) -> DataFrame:
    """rows with n_open: the candidates of their vertical that aren't masked (the target always counts); how many are, as `hidden`."""
    pool = data.candidates.groupBy("vertical").agg(F.count("*").alias("n_pool"))
    inside = data.seen.join(data.candidates.select("item_id", "vertical"), "item_id")
    masked = rows.select(*KEY).join(inside, ["user_id", "vertical"]).where("item_id <> target").groupBy(*KEY).agg(F.count("*").alias("n_hidden"))
    sized = rows.join(pool, "vertical").join(masked, list(KEY), "left").withColumn("n_hidden", F.coalesce("n_hidden", F.lit(0)))
    sized = sized.withColumn("n_open", F.col("n_pool") - F.col("n_hidden")).drop("n_pool")
    return sized.withColumnRenamed("n_hidden", hidden) if hidden else sized.drop("n_hidden")


def rank_targets(rows: DataFrame, scores: DataFrame, data: Dataset, dense: bool = False) -> DataFrame:
    """rows with rank: the candidates at least as good as the target, itself included, so ties go against it.

    No zero is filled in: a sparse target without a positive score ranks last of the candidates that aren't masked.
    """
    open_ = mask_seen(guarded(scores), data)
    own = F.max(F.when(F.col("item_id") == F.col("target"), F.col("score"))).over(Window.partitionBy(*KEY))
    better = open_.withColumn("_own", own).where("score >= _own").groupBy(*KEY).agg(F.count("*").alias("rank"), F.max("_own").alias("_own"))
    if dense:
        return rows.join(better.drop("_own"), list(KEY))
    ranked = unmasked_sizes(rows, data).join(better, list(KEY), "left")
    return ranked.withColumn("rank", F.when(F.col("_own") > 0, F.col("rank")).otherwise(F.col("n_open"))).drop("_own", "n_open")


def with_seen(rows: DataFrame, data: Dataset) -> DataFrame:
    """rows with the items that the user has in train, as the array seen."""
    seen = data.seen.groupBy("user_id").agg(F.collect_list("item_id").alias("seen"))
    none = F.array().cast(dict(seen.dtypes)["seen"])
    return rows.join(seen, "user_id", "left").withColumn("seen", F.coalesce("seen", none))


def rank_by_popularity(rows: DataFrame, data: Dataset) -> DataFrame:
    """The ranks under popularity, without a row for each candidate: the pool's counts by popularity, less the masked ones."""
    pool = data.candidates.groupBy("vertical", "pop").agg(F.count("*").alias("n"))
    above = Window.partitionBy("vertical").orderBy(F.desc("pop")).rowsBetween(Window.unboundedPreceding, 0)
    pool = pool.select("vertical", F.col("pop").alias("target_pop"), F.sum("n").over(above).alias("n_above"))
    target = data.candidates.select(F.col("item_id").alias("target"), F.col("pop").alias("target_pop"))
    rows = rows.join(target, "target").join(pool, ["vertical", "target_pop"])
    seen = data.seen.join(data.candidates, "item_id").select("user_id", "vertical", "item_id", "pop")
    hidden = rows.select(*KEY, "target_pop").join(seen, ["user_id", "vertical"]).where("item_id <> target and pop >= target_pop").groupBy(*KEY).agg(F.count("*").alias("n_hidden"))
    ranked = rows.join(hidden, list(KEY), "left").withColumn("rank", F.col("n_above") - F.coalesce("n_hidden", F.lit(0)))
    return ranked.drop("n_above", "n_hidden", "target_pop")


def with_metrics(ranked: DataFrame) -> DataFrame:
    """ranked with hit and NDCG at 5, 10, 20 and the reciprocal rank."""
    rank = F.col("rank")
    wanted = {f"{name}_at_{k}": f(rank, k) for k in KS for name, f in (("hit", hit), ("ndcg", ndcg))}
    return ranked.withColumns(wanted | {"mrr": 1 / rank})


def metric_means(per_row: DataFrame) -> DataFrame:
    """One row: n, the means of all metrics and the mean rank."""
    means = [F.round(F.avg(m), 6).alias(m) for m in (*METRICS, "mrr")]
    return per_row.agg(F.count("*").alias("n"), *means, F.round(F.avg("rank"), 6).alias("mean_rank"))


def metrics_by_slice(per_row: DataFrame, least: int = MIN_SLICE) -> DataFrame:
    """The same for each slice of at least so many rows, in one pass; slices whose column isn't there are left out."""
    known = [(name, when) for name, (needs, when) in slices().items() if needs is None or needs in per_row.columns]
    tags = F.array_compact(F.array(*[F.when(when, name) for name, when in known]))
    means = [F.round(F.avg(m), 6).alias(m) for m in (*METRICS, "mrr")]
    return per_row.withColumn("slice", F.explode(tags)).groupBy("slice").agg(F.count("*").alias("n"), *means).where(F.col("n") >= least)


def top_lists(scores: DataFrame, data: Dataset, k: int = 10) -> DataFrame:
    """(user_id, target, vertical, item_id, score, place): the k best unmasked candidates, ties by item.

    For sparse scores, rows with fewer than k positive candidates end there.
    """
    best = Window.partitionBy(*KEY).orderBy(F.desc("score"), "item_id")
    return mask_seen(guarded(scores), data).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def top_by_popularity(rows: DataFrame, data: Dataset, k: int = 10) -> DataFrame:
    """The same under popularity, without a row for each candidate: the k best are among the first k plus as many as are masked."""
    by_pop = Window.partitionBy("vertical").orderBy(F.desc("pop"), "item_id")
    pool = data.candidates.withColumn("_at", F.row_number().over(by_pop))
    sized = unmasked_sizes(rows, data, hidden="_hidden").select(*KEY, F.least(F.col("_hidden") + k, F.col("_hidden") + F.col("n_open")).cast("int").alias("_last"))
    tried = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), "_last"))).join(pool, ["vertical", "_at"])
    return top_lists(tried.select(*KEY, "item_id", F.col("pop").cast("double").alias("score")), data, k)


def coverage_and_novelty(top: DataFrame, data: Dataset) -> DataFrame:
    """One row: the share of items that some list shows, and the mean of -log2 of the shown items' popularity share."""
    n_items = data.items.agg(F.count("*").alias("n_items"))
    total = data.popularity.agg(F.sum("pop").alias("total"))
    share = F.col("pop") / F.col("total")
    shown = top.select("item_id").join(data.popularity.select("item_id", "pop"), "item_id").crossJoin(total)
    measured = shown.agg(F.count_distinct("item_id").alias("shown"), F.avg(-F.log2(F.greatest(share, F.lit(1e-12)))).alias("novelty"))
    return measured.crossJoin(n_items).select(F.round(F.col("shown") / F.col("n_items"), 6).alias("coverage_at_10"), F.round("novelty", 6).alias("novelty_at_10"))


@dataclass
class Evaluation:
    """What a trial brought: per-row results and the figures that the driver decides by."""

    model: str
    family: str
    per_row: DataFrame | None = None
    metrics: dict[str, float] = field(default_factory=dict)
    by_slice: dict[str, dict[str, float]] = field(default_factory=dict)
    fit_seconds: float = 0.0
    params: dict = field(default_factory=dict)
    error: str | None = None

    @property
    def primary(self) -> float:
        return self.metrics.get(PRIMARY, 0.0)


def leaderboard(per_row: dict[str, DataFrame], metric: str = PRIMARY) -> DataFrame:
    """(model, the metric, and on three slices): a row a model, best first."""
    frames = []
    for name, df in per_row.items():
        on = {s: slices()[s][1] for s in ("cold_in_vertical", "transfer_only", "tail_target")}
        frames.append(df.agg(F.round(F.avg(metric), 6).alias(metric), *(F.round(F.avg(F.when(c, F.col(metric))), 6).alias(f"{metric}_{s}") for s, c in on.items())).withColumn("model", F.lit(name)))
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union.orderBy(F.desc(metric), "model")


def evaluate(model, rows: DataFrame, data: Dataset, params: dict | None = None) -> Evaluation:
    """Ranks and measures a fitted model on evaluation rows. Raises on non-finite scores."""
    per_row = cut(with_metrics(model.rank(rows)))
    extra = coverage_and_novelty(model.top(rows), data).first().asDict()
    by_slice = {r["slice"]: r.asDict() for r in metrics_by_slice(per_row).collect()}
    return Evaluation(model.name, model.family, per_row, metric_means(per_row).first().asDict() | extra, by_slice, params=params or {})


def failed(name: str, family: str, error: Exception) -> Evaluation:
    return Evaluation(name, family, error=f"{type(error).__name__}: {error}")


def best(results: Sequence[Evaluation]) -> Evaluation | None:
    return max((r for r in results if not r.error), key=lambda r: r.primary, default=None)
