"""Frequency filters and the leave-one-out split in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_USER_EVENTS = 5


def frequent(events: DataFrame, key: str, least: int) -> DataFrame:
    """The events whose key occurs at least so often; counted once, not to a fixpoint."""
    often = events.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return events.join(often, key, "left_semi")


def referenced(events: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of known items, and items that have events."""
    events = events.join(items.select("item_id"), "item_id", "left_semi")
    return events, items.join(events.select("item_id"), "item_id", "left_semi")


def leave_one_out(events: DataFrame) -> DataFrame:
    """events with back (0: the user's newest) and part: test, val, train.

    Newest goes by ts, then tiebreak. Held-out events whose item nobody has in train have the part null.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("tiebreak"))
    df = events.withColumn("back", F.row_number().over(newest) - 1)
    part = F.when(F.col("back") == 0, "test").when(F.col("back") == 1, "val").otherwise("train")
    df = df.withColumn("part", part)
    trained = df.where("part = 'train'").select("item_id").distinct().withColumn("_trained", F.lit(True))
    held = df.where("part <> 'train'").join(trained, "item_id", "left").withColumn("part", F.when(F.col("_trained"), F.col("part"))).drop("_trained")
    return df.where("part = 'train'").unionByName(held)


def last_n(events: DataFrame, n: int) -> DataFrame:
    """(user_id, history): each user's n newest events as an array, oldest first."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("tiebreak"))
    kept = events.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    entry = F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), "item_id", "vertical")))
    return kept.groupBy("user_id").agg(F.transform(entry, lambda e: F.struct(e["item_id"], e["vertical"])).alias("history"))


def next_pairs(events: DataFrame) -> DataFrame:
    """(user_id, item_id, next_item): each event of a user and the one after it."""
    later = Window.partitionBy("user_id").orderBy("ts", "tiebreak")
    return events.withColumn("next_item", F.lead("item_id").over(later)).where("next_item is not null").select("user_id", "item_id", "next_item")
