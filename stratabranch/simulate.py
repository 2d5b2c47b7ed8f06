"""Simulated trees and communities. Draws come from numpy generators seeded for each tree, so a pool
is made where its rows are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabranch.session import reachable
from stratabranch.sources import newick


def yule(n: int, age: float = 1.0, seed: int = 0) -> str:
    """A pure-birth tree of n tips, scaled to the age: lineages are joined backwards, in pairs drawn at
    random, with exponential waits at the rate of the lineages left."""
    if n < 2:
        raise ValueError("a tree needs at least two tips")
    r = np.random.default_rng(seed)
    rows, heights = [], {i: 0.0 for i in range(n)}
    alive, now = list(range(n)), 0.0
    for new in range(n, 2 * n - 1):
        now += r.exponential(1 / len(alive))
        a = alive.pop(int(r.integers(len(alive))))
        b = alive.pop(int(r.integers(len(alive))))
        rows += [(new, c, now - heights[c], f"sp_{c + 1}" if c < n else None) for c in (a, b)]
        heights[new] = now
        alive.append(new)
    return newick.render(newick.from_edges([(p, c, x * age / now, label) for p, c, x, label in rows]))


def birth_death(n: int, birth: float = 1.0, death: float = 0.5, age: float = 1.0, seed: int = 0, tries: int = 1000) -> str:
    """A forward birth-death process up to n living lineages, without the dead, scaled to the age."""
    if not birth > death >= 0:
        raise ValueError("the birth rate must exceed the death rate")
    r = np.random.default_rng(seed)
    for _ in range(tries):
        parent, born, end = {1: 0, 2: 0}, {1: 0.0, 2: 0.0}, {}
        alive, now, new = [1, 2], 0.0, 3
        while 0 < len(alive) < n:
            now += r.exponential(1 / (len(alive) * (birth + death)))
            k = int(r.integers(len(alive)))
            v = alive[k]
            end[v] = now
            if r.random() < birth / (birth + death):
                alive[k] = new
                alive.append(new + 1)
                for c in (new, new + 1):
                    parent[c], born[c] = v, now
                new += 2
            else:
                alive.pop(k)
        if len(alive) < n:
            continue
        now += r.exponential(1 / (n * (birth + death)))
        end |= {v: now for v in alive}
        # Lineages with living tips, and single children merged into their parents.
        kids: dict[int, list[int]] = {}
        kept = set()
        for v in alive:
            while v and v not in kept:
                kept.add(v)
                v = parent[v]
        for v in sorted(kept):
            kids.setdefault(parent[v], []).append(v)
        root = 0
        while len(kids.get(root, [])) == 1:
            root = kids[root][0]
        rows, stack, tip = [], [root], 0
        while stack:
            p = stack.pop()
            for c in kids.get(p, []):
                length, at = end[c] - born[c], c
                while len(kids.get(at, [])) == 1:
                    at = kids[at][0]
                    length += end[at] - born[at]
                tip += at in alive
                rows.append((p, at, length, f"sp_{tip}" if at in alive else None))
                stack.append(at)
        if len(rows) < 2:
            continue
        span = now - (end[root] if root else 0.0)
        return newick.render(newick.from_edges([(p, c, x * age / span, label) for p, c, x, label in rows]))
    raise RuntimeError("every try died out")


def tree_pool(spark: SparkSession, trees: int, tips: int, model: str = "yule", age: float = 1.0, seed: int = 0) -> DataFrame:
    """tree_id, draw, newick of a pool, one seed for each tree."""
    make = {"yule": yule, "birth_death": birth_death}[model]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"tree_id": [f"tree_{k}" for k in pdf["id"]], "draw": pdf["id"], "newick": [make(tips, age=age, seed=seed + int(k)) for k in pdf["id"]]})

    return reachable(spark).range(trees).mapInPandas(run, "tree_id string, draw long, newick string")


def communities(spark: SparkSession, species: list[str], side: int, pattern: str = "random", density: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """presence and bounds of side x side unit cells. random: each species in each cell by chance;
    clustered: a disk around a centre for each species, which holds one cell at least."""
    cells = spark.range(side * side).select(F.col("id").cast("int").alias("site_pos"), (F.col("id") % side).cast("double").alias("x"), F.floor(F.col("id") / side).cast("double").alias("y"))
    names = spark.createDataFrame([(s,) for s in species], "species string")
    draw = lambda salt, *c: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *c), F.lit(1 << 30)) / float(1 << 30)
    if pattern == "random":
        pairs = names.crossJoin(cells).where(draw(1, "species", "site_pos") < density)
    elif pattern == "clustered":
        reach = side * density
        centre = names.withColumn("cx", draw(2, "species") * side - 0.5).withColumn("cy", draw(3, "species") * side - 0.5).withColumn("reach", F.greatest(F.lit(0.75), draw(4, "species") * reach))
        pairs = centre.crossJoin(cells).where(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("reach"))
    else:
        raise ValueError("the pattern is 'random' or 'clustered'")
    presence = pairs.select(F.concat(F.lit("site_"), F.col("site_pos").cast("string")).alias("site_id"), "species")
    bounds = cells.select("site_pos", F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + 1).alias("maxx"), (F.col("y") + 1).alias("maxy"))
    return presence, bounds


def grid_dataset(spark: SparkSession, trees: int = 3, tips: int = 50, side: int = 7, seed: int = 0) -> dict[str, DataFrame]:
    """A pool of birth-death trees and clustered communities on a grid, with coordinates, bounds and queen
    adjacency (of site positions)."""
    from stratabranch.operators import spatial

    present, bounds = communities(spark, [f"sp_{i + 1}" for i in range(tips)], side, "clustered", seed=seed)
    coords = bounds.select("site_pos", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    return {"trees": tree_pool(spark, trees, tips, "birth_death", seed=seed), "presence": present, "bounds": bounds, "coords": coords, "adj": spatial.from_bounds(bounds)}
