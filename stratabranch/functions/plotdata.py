"""Tables from which plots are drawn; nothing here draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.session import settle


def ecdf(values: DataFrame, value: str) -> DataFrame:
    """value, ecdf: the share of rows up to and with each row, in order. Rows are sorted by range; a row's
    place is that of its range's first, from a small table of counts, and its own within the range."""
    rows = values.where(F.col(value).isNotNull()).select(value).orderBy(value).withColumn("_row", F.monotonically_increasing_id())
    rows = settle(rows.withColumn("_part", F.shiftright("_row", 33)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.col("_row") - F.shiftleft("_part", 33) + 1
    return rows.join(F.broadcast(counts), "_part").select(value, (place / F.col("_all")).alias("ecdf"))


def histogram(values: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin (from 1), lo, hi, n of bins of equal width that have rows."""
    span = values.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    width = (F.col("hi_") - F.col("lo_")) / bins
    at = F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo_")) / width) + 1)
    rows = values.where(F.col(value).isNotNull()).join(F.broadcast(span)).withColumn("bin", F.coalesce(at, F.lit(1)).cast("long"))
    return rows.groupBy("bin", "lo_", "hi_").agg(F.count("*").alias("n")).select("bin", (F.col("lo_") + (F.col("bin") - 1) * width).alias("lo"), (F.col("lo_") + F.col("bin") * width).alias("hi"), "n")


def rate_line(profiles: DataFrame, fits: DataFrame, value: str, percentile: float = 0.95, points: int = 200, from_root: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every site: its cumulative points, its fitted curve, and the marker of its origin.

    profiles: site_id, j, age, value; fits: site_id, rate, root_age. x is time from the root, or age.
    """
    import math

    site = Window.partitionBy("site_id")
    x = lambda age: F.col("root_age") - age if from_root else age
    joined = profiles.join(fits.select("site_id", "root_age"), "site_id")
    cumulative = F.try_divide(F.sum(value).over(site.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(site))
    dots = joined.select("site_id", x(F.col("age")).alias("x"), cumulative.alias("y"))
    ages = fits.where("rate > 0").select("site_id", "rate", "root_age", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("root_age") * i / (points - 1))).alias("age"))
    curve = ages.select("site_id", x(F.col("age")).alias("x"), F.exp(-F.col("rate") * F.col("age")).alias("y"))
    origin = F.lit(-math.log(1 - percentile)) / F.col("rate")
    marker = fits.where("rate > 0").select("site_id", x(origin).alias("x"), F.lit(1 - percentile).alias("y"))
    return dots, curve, marker
