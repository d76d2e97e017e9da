"""Declared schemas of the tables that operators exchange, and their check on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EVENTS = ("user_id", "item_id", "vertical", "ts", "session_id", "tiebreak")
ITEMS = ("item_id", "vertical")
ATTRIBUTES = ("category", "price_band")  # of items, where a table has them
RATINGS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()), T.StructField("rating", T.FloatType()), T.StructField("timestamp", T.LongType())])


def require(df: DataFrame, columns: tuple[str, ...], what: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """df with just these columns and those of the optional ones that it has; ValueError names what is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df.select(*columns, *(c for c in optional if c in df.columns))
