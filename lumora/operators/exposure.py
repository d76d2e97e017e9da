"""Split tests on a logged stream of exposures: arms, sample ratio, ratio metrics, adjustment by what units did before.

Everything comes from one pass of sums by unit and one by arm, so a test over any number of users reaches the driver as two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRODUCTS = ("xx", "yy", "pp", "xy", "xp")


def units(log: DataFrame, treated: Column, numerator: Column, denominator: Column, during: Column, unit: str = "user_id") -> DataFrame:
    """(unit, treated, x, y, p): of each unit its numerator x and denominator y while the test ran, and its numerator p before.

    treated is a function of the unit; numerator and denominator are numbers of a row, null as 0. Units with a null id, or that the
    log doesn't show while the test ran, are in no arm.
    """
    part = lambda value, when: F.sum(F.when(when, F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(0.0))
    sums = log.where(F.col(unit).isNotNull()).groupBy(unit).agg(part(numerator, during).alias("x"), part(denominator, during).alias("y"), part(numerator, ~during).alias("p"), F.max(during).alias("_shown"))
    return sums.where("_shown").select(unit, treated.alias("treated"), "x", "y", "p")


def arms(found: DataFrame) -> DataFrame:
    """A row an arm: treated, n, the means of x, y and p, their variances and covariances (of samples; 0 with one unit)."""
    products = {a + b: F.sum(F.col(a) * F.col(b)) for a, b in _PRODUCTS}
    sums = found.groupBy("treated").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyp"), *(s.alias(name) for name, s in products.items()))
    spread = {name: (F.col(name) - F.col("n") * F.col(name[0]) * F.col(name[1])) / F.greatest(F.col("n") - 1, F.lit(1)) for name in _PRODUCTS}
    return sums.select("treated", "n", *(F.col(c).alias(f"mean_{c}") for c in "xyp"), *(s.alias(f"cov_{name}") for name, s in spread.items()))


def split_result(by_arm: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """One row: the arms' ratios sum(x) / sum(y), their difference with the delta method's interval, and whether it leaves zero;
    the difference of the means of x adjusted by p, with the share of its variance that this takes away; and the chi-square of equal arms.

    A ratio without denominator, and all that hangs on it, is null. A sample ratio of chi_square above 10.83 has a chance under 0.001.
    """
    of = lambda c, arm: F.max(F.when(F.col("treated") == F.lit(arm), c))
    ratio = F.try_divide("mean_x", "mean_y")
    error = F.try_divide(F.col("cov_xx") - 2 * ratio * F.col("cov_xy") + ratio * ratio * F.col("cov_yy"), F.col("mean_y") * F.col("mean_y") * F.col("n"))
    row = by_arm.withColumns({"ratio": ratio, "error": error}).agg(
        *(of(F.col(c), arm).alias(f"{c}_{name}") for c in ("n", "ratio", "error", "mean_x", "mean_p", "cov_xx", "cov_xp", "cov_pp") for arm, name in ((True, "a"), (False, "b"))),
    )
    both = lambda c: (F.col("n_a") - 1) * F.col(f"{c}_a") + (F.col("n_b") - 1) * F.col(f"{c}_b")
    theta = F.coalesce(F.try_divide(both("cov_xp"), both("cov_pp")), F.lit(0.0))
    row = row.withColumns({"theta": theta, "lift": F.col("ratio_a") - F.col("ratio_b"), "_se": F.sqrt(F.col("error_a") + F.col("error_b"))})
    variance = lambda arm: F.try_divide(F.col(f"cov_xx_{arm}") - 2 * F.col("theta") * F.col(f"cov_xp_{arm}") + F.col("theta") * F.col("theta") * F.col(f"cov_pp_{arm}"), F.col(f"n_{arm}"))
    plain = F.try_divide("cov_xx_a", "n_a") + F.try_divide("cov_xx_b", "n_b")
    adjusted = (F.col("mean_x_a") - F.col("mean_x_b")) - F.col("theta") * (F.col("mean_p_a") - F.col("mean_p_b"))
    even = (F.col("n_a") + F.col("n_b")) / 2
    ends = (F.col("lift") - z * F.col("_se"), F.col("lift") + z * F.col("_se"))
    return row.select(
        F.col("n_a").alias("n_treated"), F.col("n_b").alias("n_control"), ((F.col("n_a") - even) * (F.col("n_a") - even) / even + (F.col("n_b") - even) * (F.col("n_b") - even) / even).alias("chi_square"),
        F.col("ratio_a").alias("ratio_treated"), F.col("ratio_b").alias("ratio_control"), "lift", ends[0].alias("ci_low"), ends[1].alias("ci_high"), ((ends[0] > 0) | (ends[1] < 0)).alias("significant"),
        adjusted.alias("adjusted_delta"), F.sqrt(variance("a") + variance("b")).alias("adjusted_se"), (1 - F.try_divide(variance("a") + variance("b"), plain)).alias("variance_removed"),
    )
