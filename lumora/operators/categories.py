"""Categories found in behaviour, for catalogues that come without a taxonomy."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lumora.operators.dataset import Dataset
from lumora.session import cut

PER_VERTICAL = 30
ITEMS_A_CATEGORY = 20
STARTS = 3  # of which the closest clustering is taken


def induced(data: Dataset, per_vertical: int = PER_VERTICAL, rank: int = 64, seed: int = 0) -> Dataset:
    """data whose items carry a category c0, c1, ...: k-means within each vertical over the items' latent factors of the train part.

    The factors are those of Spark's alternating least squares; items without train events have zeros. A vertical of n items gets
    min(per_vertical, max(2, n / 20)) categories (one if it has one item), numbered on from the verticals before it by name.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from lumora.models.factor import LeastSquaresFactors

    vectors = LeastSquaresFactors(factors=rank, seed=seed).fit(data).item_factors.select("item_id", F.col("v").cast("array<double>").alias("v"))
    items = data.items.drop("category").join(vectors, "item_id", "left").withColumn("v", F.coalesce("v", F.array(*[F.lit(0.0)] * rank)))
    items = cut(items).withColumn("v", array_to_vector("v"))
    sizes = {r.vertical: r.n for r in items.groupBy("vertical").agg(F.count("*").alias("n")).collect()}  # verticals are few
    found, offset = None, 0
    for vertical in sorted(sizes):
        k = min(per_vertical, max(2, sizes[vertical] // ITEMS_A_CATEGORY), sizes[vertical])
        part = items.where(F.col("vertical") == vertical)
        near = F.lit(0) if k < 2 else F.col("prediction")
        starts = [KMeans(k=k, featuresCol="v", seed=seed + i).fit(part) for i in range(STARTS if k > 1 else 0)]
        placed = min(starts, key=lambda m: m.summary.trainingCost).transform(part) if starts else part
        placed = placed.withColumn("category", F.concat(F.lit("c"), (near + offset).cast("string"))).drop("v", "prediction")
        found, offset = placed if found is None else found.unionByName(placed), offset + k
    return replace(data, items=cut(found)) if found is not None else data
