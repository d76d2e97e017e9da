"""Datasets by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from lumora.operators.categories import induced
from lumora.operators.dataset import Dataset, build_dataset
from lumora.session import cut
from lumora.sources import ratings, simulator, tables


def _orders(spark: SparkSession, sf_dir: str, **options) -> Dataset:
    return build_dataset(tables.order_events(spark, sf_dir), tables.order_items(spark, sf_dir), **options)


def _simulated(spark: SparkSession, **options) -> Dataset:
    log = simulator.generate(spark, simulator.Settings(**options))
    data = build_dataset(log.events, log.items)
    data.log = log
    return data


def _ratings(spark: SparkSession, paths: dict[str, str], n_cross: int = 22_000, n_single: int = 8_000, min_item_count: int = 10, seed: int = 0, rank: int = 64, **options) -> Dataset:
    from pyspark.sql import functions as F

    events = cut(ratings.cross_vertical_cohort(cut(ratings.read_ratings(spark, paths)), n_cross, n_single, min_item_count, seed))
    items = events.groupBy("item_id").agg(F.min_by("vertical", F.struct("ts", "vertical")).alias("vertical"))
    return induced(build_dataset(events, items, **options), rank=rank, seed=seed)


LOADERS: dict[str, Callable[..., Dataset]] = {"orders": _orders, "simulated": _simulated, "ratings": _ratings}


def load(spark: SparkSession, name: str, **options) -> Dataset:
    """The dataset of that name; KeyError lists the names there are."""
    if name not in LOADERS:
        raise KeyError(f"no dataset {name!r}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, **options)
