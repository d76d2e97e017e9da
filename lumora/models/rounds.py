"""What models that train in rounds share: vectors drawn by hash, and means of the vectors that tasks return.

A round trains replicas from the same vectors, each on its share of the data, and averages what they return by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS = 1 << 20


def drawn(key: str, size: int, sd: float, seed: int) -> Column:
    """A vector of `size` uniform draws of the standard deviation sd, which depend on the key and the seed alone."""
    share = lambda k: F.pmod(F.xxhash64(key, k, F.lit(seed)), F.lit(DRAWS)) / DRAWS - 0.5
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: share(k) * sd * 12**0.5)


def averaged(found: DataFrame, key: str, size: int) -> DataFrame:
    """(key, v): the means of v by weight; sums of components, so that each task sends a key once."""
    total = F.sum("weight")
    return found.groupBy(key).agg(F.array(*(F.sum(F.col("v")[k] * F.col("weight")) / total for k in range(size))).alias("v"))


def shares(epochs: int, rounds: int) -> list[int]:
    """The epochs of each round: as many rounds as there are epochs at most."""
    rounds = min(epochs, rounds)
    return [epochs * (r + 1) // rounds - epochs * r // rounds for r in range(rounds)]
