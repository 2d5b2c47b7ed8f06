"""Functions under the names that users of the R package know, over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.operators import slicing, trees

# Spellings of the criteria.
_CRITERIA = {"my": "time", "million years": "time", "time": "time", "pd": "pd"}


def criterion(name: str) -> str:
    try:
        return _CRITERIA[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown criterion {name!r}") from None


def squeeze_root(edges: DataFrame, time: float, kind: str = "my", drop_nodes: bool = False) -> DataFrame:
    out = slicing.rootward(edges, time, criterion(kind))
    return trees.collapse(out) if drop_nodes else out


def squeeze_tips(edges: DataFrame, time: float, kind: str = "my", drop_nodes: bool = False) -> DataFrame:
    out = slicing.tipward(edges, time, criterion(kind))
    return trees.collapse(out) if drop_nodes else out


def squeeze_int(edges: DataFrame, start: float, stop: float, invert: bool = False, kind: str = "my", drop_nodes: bool = False) -> DataFrame | list[DataFrame]:
    """The interval; invert: the younger part, then the older one."""
    out = slicing.interval(edges, start, stop, criterion(kind), invert)
    if not invert:
        return trees.collapse(out) if drop_nodes else out
    parts = [out.where(F.col("side") == s).drop("side") for s in ("younger", "older")]
    return [trees.collapse(p) for p in parts] if drop_nodes else parts


def phylo_pieces(edges: DataFrame, n: float, method: int = 1, kind: str = "my", time_steps: bool = False):
    """Slices keyed by j. method 1: n slices; 2: slices of width n. time_steps: with the depths at which
    slices end, increasing."""
    if method not in (1, 2):
        raise ValueError("the method is 1 (a number of slices) or 2 (their width)")
    w = slicing.windows(edges, n=int(n) if method == 1 else None, width=float(n) if method == 2 else None, criterion=criterion(kind))
    found = slicing.slices(edges, w)
    if not time_steps:
        return found
    return found, w.select("tree_id", "j", F.col("hi").alias("time_step"))


def prune_tips(edges: DataFrame, time: float, quantile: bool = False, method: int = 1) -> DataFrame:
    """method 1 keeps tips at least so long, 2 those under it."""
    side = {1: "after", 2: "before"}[method]
    return slicing.prune_tips(edges, quantile=time, side=side) if quantile else slicing.prune_tips(edges, threshold=time, side=side)
