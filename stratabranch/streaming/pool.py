"""A growing pool of trees as a stream: each micro-batch's new files become per-draw rates.

Draws have no event time, so there is no watermark: rates of draws are appended, and summaries are
made again from them when asked for. The checkpoint makes a restart take up where it stopped, and a
batch that is run again replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratabranch.operators import rates
from stratabranch.session import reachable
from stratabranch.sources import newick


def watch(spark: SparkSession, folder: str, presence: DataFrame, out: str, checkpoint: str, rate: str = "cpd", n_slices: int = 100, once: bool = True) -> StreamingQuery:
    """Start the stream: one tree in each file. Rates go to out as Parquet, a folder for each batch."""
    run = rates.cpd_rate if rate == "cpd" else rates.cpe_rate
    texts = reachable(spark).readStream.option("pathGlobFilter", "*.{tre,tree,nwk,newick,t}").option("wholetext", True).text(folder).select(F.input_file_name().alias("tree_id"), F.col("value").alias("newick"))

    def step(batch: DataFrame, number: int) -> None:
        edges, rejects = newick.parse_trees(batch)
        run(edges, presence, n_slices).write.mode("overwrite").parquet(f"{out}/rates/batch={number}")
        rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")

    writer = texts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def summary(spark: SparkSession, out: str, value: str = "CpD") -> DataFrame:
    """site_id, n_trees, rate_mean, rate_median over the draws so far."""
    return spark.read.parquet(f"{out}/rates").groupBy("site_id").agg(F.count(value).alias("n_trees"), F.avg(value).alias("rate_mean"), F.median(value).alias("rate_median"))
