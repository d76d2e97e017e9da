"""The canonical interaction log from the order tables, and a second one from the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIVE_QUANTITY = 43  # what counts as a positive interaction of the order log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vertical(kind: Column) -> Column:
    return F.when(kind.isin("ECONOMY", "STANDARD"), "food").when(kind.isin("SMALL", "MEDIUM"), "quik").otherwise("shops")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items(item_id, vertical, category, price_band) of the parts."""
    vertical = _vertical(F.col("p_type"))
    band = F.floor((F.col("p_size") - 1) / 13).cast("int") + 1
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), vertical.alias("vertical"), F.concat(vertical, F.lit(":"), "p_brand").alias("category"), band.alias("price_band"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order and item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = order_items(spark, sf_dir).select("item_id", "vertical")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(items, F.col("l_partkey") == F.col("item_id"))


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings(vertical, user_id, parent_asin, rating, timestamp, title) of all order lines: a tenth of the quantity, at the order's day."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 86_400_000
    return _lines(spark, sf_dir).select("vertical", F.col("o_custkey").alias("user_id"), F.col("item_id").alias("parent_asin"), (F.col("l_quantity") / 10).alias("rating"), day.alias("timestamp"), F.lit("unread").alias("title"))


def order_events(spark: SparkSession, sf_dir: str, min_quantity: float = POSITIVE_QUANTITY) -> DataFrame:
    """events(user_id, item_id, vertical, ts, session_id, tiebreak) of the positive order lines."""
    return _lines(spark, sf_dir).where(F.col("l_quantity") >= min_quantity).select(F.col("o_custkey").alias("user_id"), "item_id", "vertical", F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("session_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("tiebreak"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns of the event stream: the vertical is the event's type, the item its key within it."""
    key = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("user_id", F.concat_ws(":", "event_type", key).alias("item_id"), F.col("event_type").alias("vertical"), "ts", F.col("user_id").alias("session_id"), F.struct("event_id").alias("tiebreak"))
