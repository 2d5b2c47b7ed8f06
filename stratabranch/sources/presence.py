"""Presence tables: long rows (site_id, species) from wide or long input, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_wide(wide: DataFrame, site: str | None = None) -> DataFrame:
    """A column for each species; present where the value is over 0. site: the first column if not named."""
    site = site or wide.columns[0]
    values = [c for c in wide.columns if c != site]
    rows = wide.select(F.col(f"`{site}`").alias("site_id"), *(F.col(f"`{c}`").cast("double").alias(c) for c in values))
    return rows.unpivot(["site_id"], values, "species", "value").where("value > 0").select("site_id", "species")


def from_long(rows: DataFrame, site: str, species: str, value: str | None = None) -> DataFrame:
    """Present where the largest value of a site and species is over 0; without a value, wherever named."""
    on = rows.select(F.col(site).alias("site_id"), F.col(species).cast("string").alias("species"), (F.col(value) if value else F.lit(1)).alias("value"))
    return on.groupBy("site_id", "species").agg(F.max("value").alias("value")).where("value > 0").select("site_id", "species")


def to_wide(rows: DataFrame, species: list[str]) -> DataFrame:
    """A 0/1 column for each named species; sites with none of them have a row too."""
    out = rows.groupBy("site_id").pivot("species", species).agg(F.max(F.lit(1)))
    return out.fillna(0, species)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV with a header whose first column is the site."""
    wide = spark.read.option("header", True).csv(path)
    first = wide.columns[0]
    return from_wide(wide.withColumnRenamed(first, "site_id"), "site_id")


def _numbered(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Rows of a CSV file with their number from 0, `_at`. Parts of the file are counted, and rows numbered
    within them, so that rows don't meet in one task."""
    from pyspark.sql import Window

    rows = spark.read.option("header", header).option("inferSchema", False).csv(path).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn("_at", (F.col("_before") + F.col("_row") - F.shiftleft("_part", 33)).cast("int")).drop("_row", "_part", "_before")


def site_order(spark: SparkSession, path: str) -> DataFrame:
    """site_id, site_pos (from 0) of a wide CSV's rows."""
    rows = _numbered(spark, path, True)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("site_id"), F.col("_at").alias("site_pos"))


def read_adjacency(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """focal, member (row and column numbers from 0) of a 0/1 matrix; with a header, the first column is
    the site and the order of columns that of sites."""
    m = _numbered(spark, path, header)
    names = m.columns[1:-1] if header else m.columns[:-1]
    rows = m.select(F.col("_at").alias("focal"), F.posexplode(F.array(*(F.col(f"`{c}`").cast("double") for c in names))).alias("member", "v"))
    return rows.where("v = 1").select("focal", "member")


def named(adj: DataFrame, sites: DataFrame) -> DataFrame:
    """adj with the names of sites (site_id, site_pos) for their places."""
    focal, member = sites.select(F.col("site_pos").alias("focal"), F.col("site_id").alias("f")), sites.select(F.col("site_pos").alias("member"), F.col("site_id").alias("m"))
    return adj.join(focal, "focal").join(member, "member").select(F.col("f").alias("focal"), F.col("m").alias("member"))
