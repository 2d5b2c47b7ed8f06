"""Adjacency of sites from bounds or coordinates, its dictionary form, and classes for maps.

adj: focal, member (site positions), with the diagonal. Contact and distance joins are equi-joins
on grid cells, so that only sites near each other meet; rectangles of different sizes lie in grids of their own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.session import settle


def cell_scale(bounds: DataFrame) -> float:
    """The median of positive widths and heights; 1 without any."""
    sides = bounds.select(F.explode(F.array(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))).alias("s")).where("s > 0")
    found = sides.agg(F.median("s")).first()[0]
    return 1.0 if found is None else float(found)


def tolerance(bounds: DataFrame, tol: float | None = None, rel_tol: float = 1e-9) -> float:
    return rel_tol * cell_scale(bounds) if tol is None else float(tol)


def from_bounds(bounds: DataFrame, method: str = "queen", tol: float | None = None, rel_tol: float = 1e-9) -> DataFrame:
    """Rectangles (site_pos, minx, miny, maxx, maxy) that touch: at a corner too (queen), or along an
    edge only (rook)."""
    if method not in ("queen", "rook"):
        raise ValueError("the method is 'queen' or 'rook'")
    t = tolerance(bounds, tol, rel_tol)
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-300)) + 2 * t
    sized = bounds.withColumn("own", F.ceil(F.log2(side)).cast("int"))
    levels = sorted(r.own for r in sized.select("own").distinct().collect())  # powers of two: a few dozen at most
    # A rectangle lies in the cells of its own size, and of every larger size that another one has.
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - t) / F.pow(F.lit(2.0), F.col("level"))), F.floor((F.col(hi) + t) / F.pow(F.lit(2.0), F.col("level"))))
    some = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col("own"))
    cells = sized.withColumn("level", F.explode(some)).withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))
    a, b = cells.where("level = own").alias("a"), cells.alias("b")
    dx = F.least("a.maxx", "b.maxx") - F.greatest("a.minx", "b.minx")
    dy = F.least("a.maxy", "b.maxy") - F.greatest("a.miny", "b.miny")
    touch = (dx >= -t) & (dy >= -t)
    if method == "rook":
        touch = touch & ((dx > t) | (dy > t))
    pairs = a.join(b, F.expr("a.level = b.level AND a.cx = b.cx AND a.cy = b.cy AND a.site_pos <> b.site_pos")).where(touch).select(F.col("a.site_pos").alias("focal"), F.col("b.site_pos").alias("member"))
    own = bounds.select(F.col("site_pos").alias("focal"), F.col("site_pos").alias("member"))
    return pairs.union(pairs.select("member", "focal")).distinct().union(own)


def _near(focal: DataFrame, coords: DataFrame, radius: float) -> DataFrame:
    """focal, member, d of sites of focal and of coords at most radius apart."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*map(F.lit, (-1, 0, 1)))
    a = focal.withColumn("cx", F.explode(F.transform(around, lambda o: cell("x") + o))).withColumn("cy", F.explode(F.transform(around, lambda o: cell("y") + o))).alias("a")
    b = coords.withColumn("cx", cell("x")).withColumn("cy", cell("y")).alias("b")
    d = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return a.join(b, F.expr("a.cx = b.cx AND a.cy = b.cy")).where(d <= radius).select(F.col("a.site_pos").alias("focal"), F.col("b.site_pos").alias("member"), d.alias("d"))


def within_radius(coords: DataFrame, radius: float) -> DataFrame:
    """Sites (site_pos, x, y) at most radius apart."""
    if not radius > 0:
        raise ValueError("the radius must be positive")
    return _near(coords, coords, radius).select("focal", "member")


def nearest(coords: DataFrame, k: int) -> DataFrame:
    """Each site's k nearest others, ties by position, made symmetric. Sites that have fewer than k others
    within a radius are looked at again with twice that radius, by themselves."""
    n = coords.count()
    if not 1 <= k < n:
        raise ValueError("k must be at least 1 and under the number of sites")
    box = coords.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    radius = max(box[0], box[1], 1e-12) * ((k + 1) / n) ** 0.5
    rank = F.row_number().over(Window.partitionBy("focal").orderBy("d", "member"))
    best, open_ = None, coords
    while True:
        found = settle(_near(open_, coords, radius).where("focal <> member").withColumn("r", rank).where(F.col("r") <= k))
        done = found.where(F.col("r") == k).select("focal")
        some = found.join(done, "focal", "left_semi").select("focal", "member")
        best = some if best is None else best.union(some)
        open_ = settle(open_.join(done.withColumnRenamed("focal", "site_pos"), "site_pos", "left_anti"))
        if not open_.limit(1).count():
            break
        radius *= 2
    own = coords.select(F.col("site_pos").alias("focal"), F.col("site_pos").alias("member"))
    return best.union(best.select("member", "focal")).union(own).distinct()


def from_polygons(shapes: DataFrame, method: str = "queen", tol: float | None = None, rel_tol: float = 1e-9) -> DataFrame:
    """Polygons (site_pos, wkt) that touch, up to a tolerance: anywhere (queen), or along more of their
    boundaries than it (rook). Needs shapely where the executors run."""
    import importlib.util

    if importlib.util.find_spec("shapely") is None:
        raise ImportError("polygon adjacency needs shapely; rectangles need from_bounds only")
    boxes = settle(shapes.select("site_pos", "wkt").mapInPandas(_boxes, "site_pos int, wkt string, minx double, miny double, maxx double, maxy double"))
    t = tolerance(boxes, tol, rel_tol)
    pairs = from_bounds(boxes.drop("wkt"), "queen", tol=t).where("focal < member")
    a, b = boxes.select(F.col("site_pos").alias("focal"), F.col("wkt").alias("a")), boxes.select(F.col("site_pos").alias("member"), F.col("wkt").alias("b"))

    def touching(batches):
        from shapely import from_wkt

        for pdf in batches:
            both = [(from_wkt(x), from_wkt(y)) for x, y in zip(pdf["a"], pdf["b"])]
            meet = [x.distance(y) <= t if method == "queen" else x.boundary.intersection(y).length > t for x, y in both]
            yield pdf.loc[meet, ["focal", "member"]]

    found = pairs.join(a, "focal").join(b, "member").mapInPandas(touching, "focal int, member int")
    own = shapes.select(F.col("site_pos").alias("focal"), F.col("site_pos").alias("member"))
    return found.union(found.select("member", "focal")).union(own)


def from_grid(cells: DataFrame, method: str = "queen", tol: float | None = None, rel_tol: float = 1e-9) -> DataFrame:
    """Polygons where there is a wkt column and shapely to read it, else rectangles by their bounds."""
    import importlib.util

    if "wkt" in cells.columns and importlib.util.find_spec("shapely") is not None:
        return from_polygons(cells, method, tol, rel_tol)
    lacking = [c for c in ("minx", "miny", "maxx", "maxy") if c not in cells.columns]
    if lacking:
        raise ValueError(f"cells need polygons (wkt, with shapely) or bounds; {', '.join(lacking)} are missing")
    return from_bounds(cells.select("site_pos", "minx", "miny", "maxx", "maxy"), method, tol, rel_tol)


def _boxes(batches):
    from shapely import from_wkt

    for pdf in batches:
        b = [from_wkt(x).bounds for x in pdf["wkt"]]
        yield pdf.assign(minx=[x[0] for x in b], miny=[x[1] for x in b], maxx=[x[2] for x in b], maxy=[x[3] for x in b])


def criterion(bounds: DataFrame, method: str = "queen", tol: float | None = None, rel_tol: float = 1e-9) -> DataFrame:
    """One row that says how an adjacency came about: method, tol, rel_tol, cell_scale, n_sites,
    n_pairs, mean_neighbours."""
    adj = from_bounds(bounds, method, tol, rel_tol)
    n = bounds.agg(F.count("*").alias("n_sites"))
    pairs = adj.agg(F.count_if(F.col("focal") < F.col("member")).alias("n_pairs"))
    return n.join(F.broadcast(pairs)).select(F.lit(method).alias("method"), F.lit(tolerance(bounds, tol, rel_tol)).alias("tol"), F.lit(rel_tol).alias("rel_tol"), F.lit(cell_scale(bounds)).alias("cell_scale"), "n_sites", "n_pairs", (2 * F.col("n_pairs") / F.col("n_sites")).alias("mean_neighbours"))


def to_dictionary(adj: DataFrame) -> DataFrame:
    """site, neighbours (sorted, as strings, without the site): one row for each entry of the map."""
    others = F.sort_array(F.collect_list(F.when(F.col("focal") != F.col("member"), F.col("member").cast("string"))))
    return adj.groupBy(F.col("focal").cast("string").alias("site")).agg(others.alias("neighbours"))


def asymmetric(adj: DataFrame) -> DataFrame:
    """Pairs whose mirror image is not there."""
    return adj.join(adj.select(F.col("focal").alias("member"), F.col("member").alias("focal")), ["focal", "member"], "left_anti")


def from_dictionary(entries: DataFrame, symmetric: bool = True) -> DataFrame:
    """adj of strings from (site, neighbours); the diagonal comes back. A neighbour that is no site is an
    error."""
    sites = entries.select(F.col("site").alias("member")).distinct()
    pairs = entries.select(F.col("site").alias("focal"), F.explode("neighbours").alias("member"))
    unknown = pairs.join(sites, "member", "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"neighbours that are no sites: {sorted(r.member for r in unknown)}")
    out = pairs.union(entries.select(F.col("site").alias("focal"), F.col("site").alias("member")))
    if symmetric:
        out = out.union(pairs.select("member", "focal"))
    return out.distinct()


def map_classes(values: DataFrame, bounds: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """bounds with the value and its class, 1 to classes by quantiles; null (grey) without a value.
    values: site_pos, value."""
    at = [k / classes for k in range(1, classes)]
    cuts = values.agg(F.percentile(value, at).alias("cuts"))
    joined = bounds.join(values.select("site_pos", value), "site_pos", "left").join(F.broadcast(cuts))
    over = F.size(F.filter("cuts", lambda c: c < F.col(value)))
    return joined.select("site_pos", "minx", "miny", "maxx", "maxy", value, F.when(F.col(value).isNotNull(), over + 1).alias("class"))
