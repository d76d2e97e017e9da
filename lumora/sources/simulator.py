"""A generative interaction log over three verticals, in DataFrame operations: every draw is a hash of its row's keys and the seed.

So the log is the same whatever the partitioning, and the true utility behind a click can be computed for any user and item.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The verticals, the tastes that span them, and their categories.
VERTICALS = ("food", "quik", "shops")
CONCEPTS = ("spicy", "healthy", "budget", "premium", "family", "late_night", "breakfast", "sweet", "beverages", "household")
CATEGORIES = {
    "food": ("biryani", "burgers", "shawarma", "sushi", "pizza", "salads", "desserts", "coffee"),
    "quik": ("fresh_produce", "dairy", "snacks", "beverages", "household", "bakery", "frozen", "personal_care"),
    "shops": ("electronics", "apparel", "home", "beauty", "toys", "sports", "books", "pharmacy"),
}
ACTIVITY = (0.92, 0.70, 0.45)
MIX = (1.1, 0.9, 0.7)


@dataclass(frozen=True)
class Settings:
    n_users: int = 4000
    items_per_vertical: int = 500
    sessions: float = 11.0
    slate: int = 12
    dim: int = 12
    rho: float = 0.55
    position_bias: float = 0.85
    popularity_alpha: float = 0.45
    attract_scale: float = 1.5
    attract_bias: float = -2.05
    explore: float = 1.3
    seed: int = 42
    days: int = 60


@dataclass
class Log:
    settings: Settings
    events: DataFrame
    items: DataFrame
    users: DataFrame
    impressions: DataFrame


def uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) that the keys determine."""
    return (F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, str) else k for k in keys]), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*keys: Column | str) -> Column:
    """A standard normal number that the keys determine (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform(*keys, F.lit("r")))) * F.cos(2 * pi * uniform(*keys, F.lit("a")))


def _vector(n: int, *keys) -> Column:
    return F.array(*[normal(*keys, F.lit(i)) for i in range(n)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def items(spark: SparkSession, s: Settings) -> DataFrame:
    """items with their latent vectors: concept (shares of 1 to 3 concepts) and private (a unit vector)."""
    seed, i = F.lit(s.seed), F.col("i")
    df = spark.range(s.items_per_vertical * len(VERTICALS)).withColumnRenamed("id", "i")
    vertical = F.element_at(F.array(*map(F.lit, VERTICALS)), F.floor(i / s.items_per_vertical).cast("int") + 1)
    df = df.withColumn("vertical", vertical)
    picked = F.when(F.col("vertical") == VERTICALS[0], F.array(*map(F.lit, CATEGORIES[VERTICALS[0]])))
    for v in VERTICALS[1:]:
        picked = picked.when(F.col("vertical") == v, F.array(*map(F.lit, CATEGORIES[v])))
    df = df.withColumn("category", F.element_at(picked, F.floor(uniform(i, seed, F.lit("category")) * 8).cast("int") + 1))
    ordered = F.sort_array(F.array(*[F.struct(uniform(i, seed, F.lit(c)).alias("u"), F.lit(c).alias("c")) for c in CONCEPTS]))
    count = F.floor(uniform(i, seed, F.lit("concepts")) * 3).cast("int") + 1
    df = df.withColumn("chosen", F.transform(F.slice(ordered, F.lit(1), count), lambda e: e["c"]))
    df = df.withColumn("concept", F.array(*[F.array_contains("chosen", c).cast("double") / F.size("chosen") for c in CONCEPTS]))
    raw = _vector(s.dim, i, seed, F.lit("item"))
    df = df.withColumn("raw", raw).withColumn("private", F.transform("raw", lambda x: x / F.sqrt(dot(F.col("raw"), F.col("raw")))))
    place = F.row_number().over(Window.orderBy(uniform(i, seed, F.lit("popularity"))))  # the catalogue is small and fixed
    df = df.withColumn("weight", F.pow(place.cast("double"), F.lit(-1.1)))
    df = df.withColumn("base_popularity", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
    item_id = F.concat(F.substring("vertical", 1, 1), F.lpad(i.cast("string"), 4, "0"))
    return df.select(item_id.alias("item_id"), "vertical", "category", F.array_join("chosen", ";").alias("concepts"), (F.floor(uniform(i, seed, F.lit("price")) * 4).cast("int") + 1).alias("price_band"), "base_popularity", "concept", "private")


def users(spark: SparkSession, s: Settings) -> DataFrame:
    """users with their mix of verticals and latent tastes: a shared part of share rho and one of each vertical's own.

    The mix draws each vertical's weight as a gamma variate by its quantile in an exponential approximation, which keeps the means.
    """
    seed, u = F.lit(s.seed), F.col("u")
    df = spark.range(s.n_users).withColumnRenamed("id", "u")
    weights = F.array(*[-F.ln(uniform(u, seed, F.lit(f"mix{k}"))) * a for k, a in enumerate(MIX)])
    df = df.withColumn("raw", weights)
    kept = [F.when((uniform(u, seed, F.lit(f"on{k}")) < p) | (F.col("raw")[k] == F.array_max("raw")), F.col("raw")[k]).otherwise(0.0) for k, p in enumerate(ACTIVITY)]
    df = df.withColumn("kept", F.array(*kept)).withColumn("mix", F.transform("kept", lambda x: x / F.aggregate("kept", F.lit(0.0), lambda a, b: a + b)))
    shared = _vector(len(CONCEPTS), u, seed, F.lit("shared"))
    tastes = F.create_map(*[x for v in VERTICALS for x in (F.lit(v), F.zip_with(shared, _vector(len(CONCEPTS), u, seed, F.lit(v)), lambda a, b: s.rho**0.5 * a + (1 - s.rho) ** 0.5 * b))])
    home = F.element_at(F.array(*map(F.lit, VERTICALS)), F.array_position("mix", F.array_max("mix")).cast("int"))
    return df.select(F.concat(F.lit("u"), F.lpad(u.cast("string"), 5, "0")).alias("user_id"), home.alias("home_vertical"), (uniform(u, seed, F.lit("owl")) < 0.3).alias("night_owl"), "mix", tastes.alias("taste"), _vector(s.dim, u, seed, F.lit("own")).alias("own"))


def utility(pairs: DataFrame) -> Column:
    """The true utility of rows that carry a user's taste and own and an item's concept, private and vertical."""
    return 1.6 * dot(F.element_at("taste", F.col("vertical")), F.col("concept")) + 0.7 * dot(F.col("own"), F.col("private"))


def click_probability(value: Column, position: Column, s: Settings) -> Column:
    """Examined with position_bias ** position, attractive with a logistic of the utility; 0.95 at most."""
    attract = 1 / (1 + F.exp(-(s.attract_scale * value + s.attract_bias)))
    return F.least(F.greatest(F.pow(F.lit(s.position_bias), position) * attract, F.lit(0.0)), F.lit(0.95))


def generate(spark: SparkSession, s: Settings = Settings()) -> Log:
    """Sessions of each user, each a slate of one vertical chosen by popularity and noise; clicks become events."""
    seed = F.lit(s.seed)
    catalogue, people = items(spark, s), users(spark, s)
    # a Poisson number of further sessions: as many unit-rate waits as fit into the mean
    waits = F.transform(F.sequence(F.lit(1), F.lit(int(s.sessions * 3 + 20))), lambda k: -F.ln(uniform(F.col("user_id"), seed, F.lit("wait"), k)))
    upto = F.aggregate(waits, F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("n")), lambda a, w: F.struct((a["t"] + w).alias("t"), (a["n"] + F.when(a["t"] + w <= s.sessions, 1).otherwise(0)).alias("n")))["n"]
    sessions = people.withColumn("session", F.explode(F.sequence(F.lit(0), upto)))
    key = (F.col("user_id"), F.col("session"), seed)
    draw = uniform(*key, F.lit("vertical"))
    vertical = F.when(draw < F.col("mix")[0], VERTICALS[0]).when(draw < F.col("mix")[0] + F.col("mix")[1], VERTICALS[1]).otherwise(VERTICALS[2])
    hour = F.pmod(F.floor(F.when(F.col("night_owl"), 21).otherwise(13) + 3 * normal(*key, F.lit("hour"))), F.lit(24))
    start = F.lit("2025-06-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(uniform(*key, F.lit("day")) * s.days * 86400) + hour * 3600)
    sessions = sessions.withColumn("vertical", vertical).withColumn("hour", hour.cast("int")).withColumn("ts", start)
    shown = sessions.join(F.broadcast(catalogue), "vertical")
    appeal = s.popularity_alpha * F.ln(F.col("base_popularity") + 1e-12) + s.explore * normal(*key, F.col("item_id"), F.lit("shown"))
    slate = F.row_number().over(Window.partitionBy("user_id", "session").orderBy(F.desc("appeal"), "item_id")) - 1
    shown = shown.withColumn("appeal", appeal).withColumn("rank", slate).where(F.col("rank") < s.slate)
    clicked = uniform(*key, F.col("item_id"), F.lit("click")) < click_probability(utility(shown), F.col("rank"), s)
    session_id = F.concat("user_id", F.lit("_s"), F.col("session").cast("string"))
    impressions = shown.select("user_id", "item_id", "vertical", "rank", "ts", clicked.cast("int").alias("clicked"), session_id.alias("session_id"), "hour")
    events = impressions.where("clicked = 1").select("user_id", "item_id", "vertical", "ts", "session_id", F.struct("session_id", "rank", "item_id").alias("tiebreak"), "hour", F.lit("order").alias("event_type"))
    return Log(s, events, catalogue, people, impressions)
