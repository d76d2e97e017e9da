"""Rating files, one a category of products, as an interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.draws import digest
from lumora.operators.split import frequent
from lumora.schema import RATINGS


def read_ratings(spark: SparkSession, paths: dict[str, str], min_rating: float = 4.0) -> DataFrame:
    """events of the ratings of min_rating or more; paths: vertical -> CSV with user_id, parent_asin, rating, timestamp in milliseconds.

    Columns are taken by name, others aren't parsed. session_id is the user: such files have no sessions.
    """
    frames = []
    for vertical, path in paths.items():
        names = spark.read.option("header", True).csv(path).columns
        kinds = {f.name: f.dataType for f in RATINGS}
        schema = ", ".join(f"`{n}` {kinds[n].simpleString() if n in kinds else 'string'}" for n in names)
        raw = spark.read.option("header", True).schema(schema).csv(path).select(*RATINGS.names)
        frames.append(raw.where(F.col("rating") >= min_rating).withColumn("vertical", F.lit(vertical)))
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    ts = F.timestamp_millis("timestamp")
    return union.select("user_id", F.col("parent_asin").alias("item_id"), "vertical", ts.alias("ts"), F.col("user_id").alias("session_id"), F.struct("timestamp", "parent_asin").alias("tiebreak"))


def sampled_users(events: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """events of n users, the first by a digest of user and seed: the same ones each time."""
    users = events.select("user_id").distinct().orderBy(digest("user_id", seed=seed), "user_id").limit(n)
    return events.join(users, "user_id", "left_semi")


def cross_vertical_cohort(events: DataFrame, n_cross: int = 22_000, n_single: int = 8_000, min_item_count: int = 10, seed: int = 0) -> DataFrame:
    """events of n_cross users of several verticals and n_single of one, then of items with min_item_count events."""
    touched = events.groupBy("user_id").agg(F.count_distinct("vertical").alias("n"))
    picked = [events.join(touched.where(F.col("n") >= 2), "user_id", "left_semi"), events.join(touched.where(F.col("n") == 1), "user_id", "left_semi")]
    cohort = sampled_users(picked[0], n_cross, seed).unionByName(sampled_users(picked[1], n_single, seed))
    return frequent(cohort, "item_id", min_item_count)


def write_ratings(ratings: DataFrame, folder: str) -> dict[str, str]:
    """Writes ratings(vertical, user_id, parent_asin, rating, timestamp, ...) as CSV files with a header; the paths by vertical."""
    ratings.write.partitionBy("vertical").option("header", True).csv(folder)
    return {r.vertical: f"{folder}/vertical={r.vertical}" for r in ratings.select("vertical").distinct().collect()}  # verticals are few
