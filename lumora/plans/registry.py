"""The registered queries of the library's operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions import columns
from lumora.models.bridge import CategoryBridge
from lumora.models.fusion import TwoStage
from lumora.models.neighbours import ItemNeighbours, Popularity, cooccurrence
from lumora.models.walk import GraphWalk, graph_edges, item_edges
from lumora.operators import compare, evaluate, exposure, sampling, split
from lumora.operators.dataset import Dataset, build_dataset
from lumora.functions import draws
from lumora.plans import sql
from lumora.session import scratch
from lumora.sources import ratings, tables
from lumora.streaming import sessions

KEY = [*evaluate.KEY]
Query = Callable[[SparkSession, str], DataFrame]


def _data(spark: SparkSession, sf_dir: str, **options) -> Dataset:
    return build_dataset(tables.order_events(spark, sf_dir), tables.order_items(spark, sf_dir), **options)


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select(*KEY, "item_id", F.round("score", 8).alias("score"))


def _ranks(ranked: DataFrame) -> DataFrame:
    return ranked.select(*KEY, "rank")


def _line(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.col("tiebreak.l_linenumber"))


def _measured(data: Dataset, model) -> DataFrame:
    return evaluate.with_metrics(model.fit(data).rank(data.eval_rows()))


def _paired(data: Dataset) -> DataFrame:
    return compare.paired(_measured(data, GraphWalk(use_metadata=False)), _measured(data, Popularity()))


def _summary(df: DataFrame) -> DataFrame:
    return compare.paired_summary(df).select("n", "n_informative", *(F.round(c, 8).alias(c) for c in ("baseline", "delta")), F.round("rel_lift_pct", 4).alias("rel_lift_pct"), *(F.round(c, 8).alias(c) for c in ("win_rate", "pooled_sd")))


def _power(data: Dataset) -> DataFrame:
    row = compare.paired_summary(_paired(data)).select(F.col("delta").alias("effect"), "pooled_sd")
    z = F.lit((1.959963984540054 + 0.8416212335729144) ** 2)  # of alpha 0.05 and power 0.8
    n = F.ceil(2 * z * F.col("pooled_sd") * F.col("pooled_sd") / (F.col("effect") * F.col("effect"))).cast("long")
    n = F.when((F.col("effect") == 0) | (F.col("pooled_sd") <= 0), F.lit(-1).cast("long")).otherwise(n)
    return row.select(F.round("effect", 8).alias("effect"), F.round("pooled_sd", 8).alias("pooled_sd"), n.alias("required_n_per_arm"))


def _features(data: Dataset) -> DataFrame:
    scores = ItemNeighbours(150).fit(data).score(data.eval_rows())
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.round("score", 10)), "item_id")) - 1
    ranks = columns.percent_rank_average(data.popularity, "pop", "pop_pct").select("item_id", F.round(F.log1p("pop"), 8).alias("log_pop"), F.round("pop_pct", 8).alias("pop_pct"))
    rows = data.eval_rows().select(*KEY, "hist_len", "in_vertical_hist", "cold_in_vertical")
    joined = scores.withColumn("knn_rank", place).join(ranks, "item_id").join(rows, KEY)
    other = F.col("hist_len") - F.col("in_vertical_hist")
    return joined.select(
        "user_id", "target", "item_id", "knn_rank", "log_pop", "pop_pct", F.col("hist_len").alias("hist_total"), F.col("in_vertical_hist").alias("hist_in_vertical"), other.alias("hist_other_verticals"),
        F.round(other / F.greatest("hist_len", F.lit(1)), 8).alias("share_other"), F.col("cold_in_vertical").alias("cold"),
    )


def _stage(data: Dataset) -> TwoStage:
    """The second stage over one retriever, as far as its feature rows need it."""
    stage = TwoStage([ItemNeighbours(150).fit(data)])
    stage.data = data
    return stage


def _dense(data: Dataset, places: int | None = None) -> DataFrame:
    """The second stage's own feature rows: every evaluation row with every candidate, score 0 where the retriever has none."""
    return _stage(data).features(data.eval_rows(), places)


def _features_full(data: Dataset) -> DataFrame:
    rounded = (F.col(c).alias(n) for c, n in (("score0", "knn_score"), ("log_pop", "log_pop"), ("pop_pct", "pop_pct"), ("share_other", "share_other")))
    counts = (F.col(c).cast("long").alias(n) for c, n in (("rank0", "knn_rank"), ("hist_total", "hist_total"), ("hist_in_vertical", "hist_in_vertical"), ("hist_other", "hist_other_verticals")))
    return _dense(data, 8).select("user_id", "target", "item_id", *counts, *rounded, (F.col("cold") > 0).alias("cold"))


def _blended(data: Dataset) -> DataFrame:
    rows, bridge = data.eval_rows(), CategoryBridge().fit(data)
    if bridge.alike is None:
        return _blended_pairs(data, bridge)
    keep = ("target_category", "target_pop", "hidden")
    both = bridge.score_alike(bridge.with_values(bridge.with_hidden(rows.select(*KEY))), keep).drop("items").withColumns({"a": F.col("score"), "b": F.col("pop").cast("double")})
    same = lambda category, pop: F.col("category").eqNullSafe(category) & (F.col("pop") == pop)
    own = same(F.col("target_category"), F.col("target_pop"))
    both = both.select(*KEY, own.alias("mine"), "n", (F.col("n") - F.size(F.filter("hidden", lambda h: same(h["category"], h["pop"])))).alias("n_open"), "a", "b")
    mixed = compare.blended(both, [0.25, 0.75], "n").withColumn("score", F.round("score", 6))
    key = ["user_id", "target", "vertical", "alpha"]
    mixed = mixed.withColumn("own", F.max(F.when(F.col("mine"), F.col("score"))).over(Window.partitionBy(*key)))
    return mixed.where("score >= own").groupBy(*key).agg(F.sum("n_open").alias("rank")).select("user_id", "target", "alpha", "rank")


def _blended_pairs(data: Dataset, bridge: CategoryBridge) -> DataFrame:
    rows = data.eval_rows()
    mixed = compare.blend(bridge.score(rows), Popularity().fit(data).scores(rows), [0.25, 0.75])
    key = ["user_id", "target", "vertical", "alpha"]
    open_ = evaluate.mask_seen(mixed, data).withColumn("score", F.round("score", 6))
    own = F.max(F.when(F.col("item_id") == F.col("target"), F.col("score"))).over(Window.partitionBy(*key))
    return open_.withColumn("own", own).where("score >= own").groupBy(*key).agg(F.count("*").alias("rank")).select("user_id", "target", "alpha", "rank")


def _nonfinite(data: Dataset) -> DataFrame:
    rows, bridge = data.eval_rows(), CategoryBridge().fit(data)
    return evaluate.check_finite(bridge.score(rows)) if bridge.alike is None else evaluate.check_finite(bridge.score_alike(bridge.with_values(rows.select(*KEY))), "n")


def _history(data: Dataset) -> DataFrame:
    entries = F.transform("history", lambda e: F.concat_ws("@", e["item_id"].cast("string"), e["vertical"]))
    return split.last_n(data.train, 5).select("user_id", F.array_join(entries, " ").alias("history"))


def _stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.leave_one_out(tables.stream_events(spark, sf_dir)).select("user_id", "item_id", "vertical", "tiebreak.event_id", "part")


def _slates(data: Dataset) -> DataFrame:
    rows = data.eval_rows()
    return compare.interleave(GraphWalk(use_metadata=False).fit(data).top(rows), Popularity().fit(data).top(rows))


def _negatives(data: Dataset) -> DataFrame:
    return _stage(data).drawn(data.eval_rows(), n_hard=8, n_easy=16)


def _replicates(data: Dataset) -> DataFrame:
    return compare.replicates(_paired(data))


def _interval(data: Dataset) -> DataFrame:
    found = compare.replicate_interval(_replicates(data))
    return found.select("n_replicates", *(F.round(c, 8).alias(c) for c in ("ci_low", "ci_high", "p_value")), *(F.round(c, 5).alias(c) for c in ("rel_ci_low", "rel_ci_high")), "significant")


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a test of two arms in its second half of January: clicks over views, and clicks before it."""
    log = tables.table(spark, sf_dir, "events")
    is_a = lambda kind: (F.col("event_type") == kind).cast("int")
    return exposure.arms(exposure.units(log, draws.coin("user_id", F.lit("arm")), is_a("click"), is_a("view"), F.dayofmonth("ts") > 15))


def _rounded_doubles(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 8).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def _rating_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines written as rating files, one folder a vertical, and read back."""
    return ratings.read_ratings(spark, ratings.write_ratings(tables.order_ratings(spark, sf_dir), scratch(spark, "ratings-")))


def _rating_columns(df: DataFrame) -> DataFrame:
    return df.select("user_id", "item_id", "vertical", F.col("tiebreak.timestamp").alias("timestamp"))


def _spans(df: DataFrame) -> DataFrame:
    said = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.select("user_id", said("start").alias("began"), said("end").alias("ended"), "n")


def _live(spark: SparkSession, sf_dir: str, stream: bool) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    events = (sessions.files_as_stream(spark, path) if stream else spark.read.parquet(path)).withColumn("item_id", F.get_json_object("props", "$.k")).withColumn("ts", F.col("ts").cast("timestamp"))
    found = sessions.live_sessions(events)
    return sessions.drained(found) if stream else found


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.live_popularity(tables.stream_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "vertical", "item_id", "n")


#: Queries over the split order log.
_OF_DATA: dict[str, Callable[[Dataset], DataFrame]] = {
    "item_dimension": lambda d: d.items,
    "user_activity_filter": lambda d: _line(d.events).select("user_id", "item_id", "ts", "session_id", "line"),
    "loo_split": lambda d: _line(d.events).select("user_id", "item_id", "session_id", "line", "back", "part"),
    "train_only_targets": lambda d: d.events.where("part in ('test', 'val')").select("user_id", "item_id", "part"),
    "item_popularity": lambda d: d.popularity.select("item_id", "vertical", "pop"),
    "candidate_pool": lambda d: d.candidates.select("item_id", "vertical", "pop"),
    "user_vertical_counts_pivot": lambda d: d.vertical_counts(["food", "quik", "shops"]),
    "user_vertical_unpivot": lambda d: d.vertical_counts(["food", "quik", "shops"]).unpivot("user_id", ["food", "quik", "shops"], "vertical", "n").where("n > 0"),
    "popularity_percentile": lambda d: columns.percent_rank_average(d.popularity, "pop", "pct").select("item_id", F.round("pct", 8).alias("pct")),
    "eval_frame": lambda d: d.eval_rows().withColumn("target_pop_pct", F.round("target_pop_pct", 8)),
    "gini_popularity": lambda d: columns.gini(d.popularity, "pop").select(F.round("gini", 6).alias("gini")),
    "dataset_profile": lambda d: d.profile(),
    "seen_mask": lambda d: evaluate.unmasked_sizes(d.eval_rows(), d).select("user_id", "target", "n_open"),
    "score_popularity": lambda d: Popularity().fit(d).scores(d.eval_rows()),
    "rank_popularity": lambda d: _ranks(evaluate.rank_by_popularity(d.eval_rows(), d)),
    "metrics_popularity": lambda d: evaluate.metric_means(_measured(d, Popularity())),
    "slice_metrics": lambda d: evaluate.metrics_by_slice(_measured(d, Popularity())),
    "coverage_novelty": lambda d: evaluate.coverage_and_novelty(evaluate.top_by_popularity(d.eval_rows(), d), d),
    "top10_popularity": lambda d: evaluate.top_by_popularity(d.eval_rows(), d).select(*KEY, "item_id", "place"),
    "top10_knn": lambda d: evaluate.top_lists(ItemNeighbours(150).fit(d).score(d.eval_rows()), d).select(*KEY, "item_id", "place"),
    "nonfinite_count": _nonfinite,
    "item_cooccurrence": lambda d: cooccurrence(d.seen),
    "knn_similarity_topk": lambda d: ItemNeighbours(150).fit(d).similarity.select("i", "j", F.round("similarity", 10).alias("similarity")),
    "knn_recency_profile": lambda d: ItemNeighbours(150, recency_halflife=5.0).fit(d).history().select("user_id", "i", F.round("weight", 8).alias("weight")),
    "score_knn": lambda d: _rounded(ItemNeighbours(150).fit(d).score(d.eval_rows())),
    "rank_knn": lambda d: _ranks(evaluate.rank_targets(d.eval_rows(), ItemNeighbours(150).fit(d).score(d.eval_rows()), d)),
    "walk_edges": lambda d: item_edges(d).select("src", "dst", F.round("w", 8).alias("w")),
    "kg_edges": lambda d: graph_edges(d).select("src", "dst", F.round("w", 8).alias("w")),
    "kg_attribute_mass": lambda d: graph_edges(d).where("src like 'item=%'").groupBy("src").agg(F.round(F.sum(F.when(~F.col("dst").like("item=%"), F.col("w"))), 8).alias("mass")),
    "walk_seeds": lambda d: GraphWalk(use_metadata=False).fit(d).seeds(d.eval_rows()).select("user_id", "vertical", "node", F.round("w", 8).alias("w")),
    "score_walk_within": lambda d: _rounded(GraphWalk(cross_vertical=False, use_metadata=False).fit(d).score(d.eval_rows())),
    "score_walk_xvert": lambda d: _rounded(GraphWalk(use_metadata=False).fit(d).score(d.eval_rows())),
    "rank_walk_xvert": lambda d: _ranks(_measured(d, GraphWalk(use_metadata=False))),
    "rank_walk_kg": lambda d: _ranks(_measured(d, GraphWalk())),
    "bridge_affinity": lambda d: CategoryBridge().fit(d).affinity.select("a", "b", "co", F.round("affinity", 8).alias("affinity")),
    "bridge_top_transfers": lambda d: CategoryBridge().fit(d).top_transfers(12).withColumn("affinity", F.round("affinity", 8)),
    "score_bridge": lambda d: CategoryBridge().fit(d).score(d.eval_rows(), places=8),
    "rank_bridge": lambda d: _ranks(_measured(d, CategoryBridge())),
    "leaderboard": lambda d: evaluate.leaderboard({m.name: _measured(d, m) for m in (Popularity(), ItemNeighbours(150), GraphWalk(use_metadata=False))}),
    "paired_delta": lambda d: _summary(_paired(d)),
    "paired_delta_by_slice": lambda d: compare.informative(_paired(d)),
    "informative_rows": lambda d: _paired(d).select(*KEY, ((F.col("x") > 0) | (F.col("y") > 0)).alias("informative")),
    "power_analysis": _power,
    "percentile_of_ranks": lambda d: evaluate.rank_by_popularity(d.eval_rows(), d).groupBy("vertical").agg(*(F.round(F.percentile("rank", F.lit(p)), 6).alias(n) for n, p in (("low", 0.025), ("high", 0.975)))),
    "rowwise_zscore": lambda d: ItemNeighbours(150).fit(d).score(d.eval_rows()).select(*KEY, "item_id", F.round(columns.zscore("score", KEY), 6).alias("z")),
    "fusion_features": _features,
    "rowwise_zscore_full": lambda d: _stage(d).zscores(d.eval_rows(), 6),
    "fusion_features_full": _features_full,
    "blend_rank": _blended,
    "interleaved_slates": _slates,
    "interleaved_outcomes": lambda d: compare.interleaved_outcomes(_slates(d)),
    "sampled_negatives": _negatives,
    "validation_sample": lambda d: sampling.rows_by_vertical(d.eval_rows("val"), 100).select(*KEY, "hist_len"),
    "bootstrap_replicates": lambda d: _rounded_doubles(_replicates(d)),
    "bootstrap_interval": _interval,
    "sequence_pairs": lambda d: split.next_pairs(d.train),
    "last_n_history": _history,
}

#: Queries over the tables themselves.
_OF_TABLES: dict[str, Query] = {
    "interaction_log": lambda s, p: _line(tables.order_events(s, p)).select("user_id", "item_id", "vertical", "ts", "session_id", "line"),
    "item_frequency_filter": lambda s, p: _line(split.frequent(tables.order_events(s, p), "item_id", 10)).select("user_id", "item_id", "session_id", "line"),
    "multi_vertical_users": lambda s, p: tables.order_events(s, p).groupBy("user_id").agg(F.count_distinct("vertical").alias("n_verticals"), F.count("*").alias("n")).where("n_verticals >= 2"),
    "capped_candidate_pool": lambda s, p: _data(s, p, max_candidates=100).candidates.select("item_id", "vertical", "pop"),
    "stream_split": _stream_split,
    "rating_log": lambda s, p: _rating_columns(_rating_log(s, p)),
    "rating_cohort": lambda s, p: _rating_columns(ratings.cross_vertical_cohort(_rating_log(s, p), n_cross=60, n_single=20, min_item_count=2)),
    "split_test_arms": lambda s, p: _rounded_doubles(_arms(s, p)),
    "split_test_result": lambda s, p: _rounded_doubles(exposure.split_result(_arms(s, p))),
    "event_sessions": lambda s, p: _spans(_live(s, p, stream=False)),
    "stream_sessions": lambda s, p: _spans(_live(s, p, stream=True)),
    "daily_popularity": _daily,
}


def queries() -> dict[str, Query]:
    return _OF_TABLES | {name: (lambda s, p, f=f: f(_data(s, p))) for name, f in _OF_DATA.items()}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
