"""Mixing sources to target weights by entropy balancing.

Rates stay as near as they can, in relative entropy, to one copy of every document, while each
source's tokens meet its target. The solution is exponentially tilted: a document of size z in a
source with multiplier m has the rate min(2, exp(m * z / mean size)). The dual is convex and
falls apart by source; Newton steps, kept inside a bracket, run as aggregations over the table of
(source, size, documents), which holds every document exactly and is what iterations read.

Rates become copies by error feedback down the sizes of a source, so that the tokens taken miss
the target by no more than about the smallest size that is left to adjust. Within documents of
one source and size, those with the smallest hash of doc_id get the extra copy: a cutoff for
each source and size, found in buckets of the hash, then in buckets of the bucket that it falls in, so
that no task ranks a hot group alone.

Words are counted once; plans are made of the counts. Sources are a small table that one task shares out, and
the distinct sizes of a source are rounded by one task; documents never are.

Null text has size 0 and one copy. A null source is a source of its own, last in order. Rows that
share a doc_id, source and size (all null ids of one size, for one) get the same copies. An empty table
gives no rows. A source whose multiplier can't be found is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.llm.common import cut, free_name, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
STEPS = 80
#: Of the target.
TOLERANCE = 1e-8
#: Multipliers are searched where the exponent of the smallest document is within this.
REACH = 60.0
#: Buckets are the top bits of a hash: 64 of them, with 64 each.
SHIFTS = (58, 52)
#: Rows of the plan up to which it may be broadcast (about 50 bytes each).
BROADCAST_ROWS = 50_000
#: How far a solved source may be from its target, of the target.
MISS = 1e-4


def words(column: str = "text") -> Column:
    """The number of words: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sid and target added to one row for each source (source, source_size, ...).

    Targets are proportional to weight until they meet most times the source's size; what the cap
    frees is shared again. That is a water level: target = min(most * size, level * weight), with
    the level found in order of the levels at which sources fill up.
    """
    everything = Window.partitionBy()
    order = everything.orderBy(F.col("source").cast("binary").asc_nulls_last())
    filled = everything.orderBy("_fill", "sid")
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.withColumn("sid", F.row_number().over(order) - 1)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("_own", level)
        .withColumn("_level", F.min_by("_own", F.when(F.col("_own") <= F.col("_fill"), F.col("_fill"))).over(everything))
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_weight"))))
        .drop("_weight", "_cap", "_fill", "_total", "_own", "_level")
    )


def solve(hist: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """sid, multiplier of each source that has words.

    hist: sid, size, n, z (size over the source's mean), source_size, target. One aggregation for
    each Newton step; the driver learns only whether a source is still open.
    """
    base = cut(hist.where("size > 0").select("sid", "size", "n", "z", "source_size", "target"))
    bound = F.lit(REACH) / F.min("z")
    full = F.first("target") >= F.first("source_size") * F.lit(most * (1 - 1e-12))
    state = cut(base.groupBy("sid").agg(F.when(full, bound).otherwise(0.0).alias("m"), (-bound).alias("lo"), bound.alias("hi"), full.alias("done"), F.lit(0.0).alias("missed")))
    rate = F.exp(F.col("m") * F.col("z"))
    tokens = F.col("n") * F.col("size")
    for _ in range(steps):
        if not state.where("NOT done").limit(1).count():
            break
        sums = (
            base.join(state.drop("missed"), "sid")
            .groupBy("sid", "m", "lo", "hi", "done", "target")
            .agg(
                F.sum(tokens * F.least(F.lit(float(most)), rate)).alias("got"),
                F.sum(F.when(rate < most, tokens * F.col("z") * rate).otherwise(0.0)).alias("slope"),
            )
            .withColumn("gap", F.col("got") - F.col("target"))
            .withColumn("lo", F.when(F.col("gap") <= 0, F.col("m")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("gap") > 0, F.col("m")).otherwise(F.col("hi")))
            .withColumn("done", F.col("done") | (F.abs("gap") <= F.lit(TOLERANCE) * F.col("target")) | (F.col("hi") - F.col("lo") <= F.lit(1e-12) * (1 + F.abs("m"))))
            .withColumn("step", F.when(F.col("slope") > 0, F.col("m") - F.col("gap") / F.col("slope")))
        )
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        state = cut(sums.select("sid", F.when(F.col("done"), F.col("m")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("m"), "lo", "hi", "done", (F.abs("gap") / F.col("target")).alias("missed")))
    wrong = state.where(~F.col("done") | (F.col("missed") > MISS)).limit(1).collect()
    if wrong:
        raise RuntimeError(f"the multiplier of source {wrong[0].sid} wasn't found in {steps} steps")
    return state.select("sid", F.col("m").alias("multiplier"))


def round_copies(most: int):
    """A function of one source's sizes: copies of each size by error feedback, largest first."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ascending=False, kind="stable")
        copies, owed = [], 0.0
        for size, n, rate in zip(part["size"].tolist(), part["n"].tolist(), part["rate"].tolist()):
            if size == 0:
                copies.append(n)
                continue
            owed += rate * n * size
            copies.append(min(most * n, max(0, int(np.floor(owed / size + 0.5)))))
            owed -= copies[-1] * size
        return part[["sid", "size", "n"]].assign(copies=copies)

    return work


def mixing_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, size, source_size, target, base, cutoff: what a document of a source and size gets.

    It gets base copies, and one more if its u is at most cutoff. rows: source, size, u (a hash of doc_id).
    """
    rows = cut(rows.select("source", "size", "u"))
    hist = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    targets = cut(source_targets(totals, weights, share, most))
    z = F.when(F.col("size") > 0, F.col("size") * F.col("docs") / F.col("source_size"))
    full = cut(hist.alias("h").join(targets.alias("t"), F.expr("h.source <=> t.source")).select("h.source", "sid", "size", "n", z.alias("z"), "source_size", "target"))
    rate = F.coalesce(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("z"))), F.lit(1.0))
    copies = full.join(solve(full, most), "sid", "left").select("sid", "size", "n", rate.alias("rate")).groupBy("sid").applyInPandas(round_copies(most), "sid int, size long, n long, copies long")
    base = F.floor(F.col("copies") / F.col("n"))
    plan = cut(full.join(copies.drop("n"), ["sid", "size"]).withColumn("base", base).withColumn("extra", F.col("copies") - base * F.col("n")))
    return plan.join(cutoffs(rows, plan), ["sid", "size"], "left").select("source", "size", "source_size", "target", "base", "cutoff")


def cutoffs(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """sid, size, cutoff: the hash up to which extra documents of a source and size lie."""
    first, second = (F.shiftright("u", s) for s in SHIFTS)
    partly = rows.alias("r").join(plan.where("extra > 0").alias("p"), F.expr("r.source <=> p.source AND r.size = p.size")).select("sid", "r.size", "extra", "u", first.alias("b1"), second.alias("b2"))

    def crossing(counts: DataFrame, by: str) -> DataFrame:
        """Where the running count of k meets extra, and how many are left to take there."""
        upto = F.sum("k").over(Window.partitionBy("sid", "size").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("upto", upto).where("upto >= extra AND upto - k < extra").select("sid", "size", by, (F.col("extra") - F.col("upto") + F.col("k")).alias("extra"))

    fine = cut(partly.groupBy("sid", "size", "extra", "b1", "b2").agg(F.count("*").alias("k")))
    at = crossing(fine.groupBy("sid", "size", "extra", "b1").agg(F.sum("k").alias("k")), "b1")
    at = crossing(fine.drop("extra").join(at, ["sid", "size", "b1"]).select("sid", "size", "extra", "b2", "k"), "b2")
    # Equal hashes are one row here, however many documents share an id.
    last = partly.drop("extra", "b1").join(at, ["sid", "size", "b2"]).groupBy("sid", "size", "extra", "u").agg(F.count("*").alias("k"))
    return crossing(last, "u").select("sid", "size", F.col("u").alias("cutoff"))


def with_copies(rows: DataFrame, plan: DataFrame, size: str, u: str, names: dict[str, str]) -> DataFrame:
    """rows (with their size and hash u) and the plan's columns under the given names, and copies. Rows
    aren't shuffled where the plan (sources times distinct sizes) is small enough to be broadcast."""
    plan = cut(plan)
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    copies = (F.col("p.base") + F.when(F.col(f"d.`{u}`") <= F.col("p.cutoff"), 1).otherwise(0)).cast("int")
    return rows.alias("d").join(plan.alias("p"), F.expr(f"d.source <=> p.source AND d.`{size}` = p.size")).select(
        *(F.col(f"d.`{c}`") for c in rows.columns), *(F.col(f"p.{c}").alias(name) for c, name in names.items()), copies.alias(free_name(rows, "copies"))
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row."""
    rows = cut(docs.select("doc_id", "source", words().alias("size"), F.xxhash64("doc_id").alias("u")))
    found = with_copies(rows, mixing_plan(rows, **options), "size", "u", {"source_size": "source_size", "target": "target"})
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    size, u = free_name(docs, "size_"), free_name(docs, "u_")
    rows = stored(docs.withColumn(size, words()).withColumn(u, F.xxhash64("doc_id")))
    plan = mixing_plan(rows.select("source", F.col(f"`{size}`").alias("size"), F.col(f"`{u}`").alias("u")), weights, share, most)
    found = with_copies(rows, plan, size, u, {})
    copies = found.columns[-1]
    once = free_name(found, "copy_")
    return found.where(F.col(f"`{copies}`") > 0).withColumn(once, F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`")))).select(*docs.columns)
