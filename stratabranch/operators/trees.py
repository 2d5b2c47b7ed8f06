"""Operators on edge tables: depth, closure, checks, pruning, collapsing.

edges: tree_id, edge_id, parent, child, length, b, d (depths of parent and child), tip_lo, tip_hi
(the tips below, numbered along the tree), is_tip, label. Every operator is keyed by tree_id, so one
tree and a pool of trees are the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratabranch.session import settle

#: Spread of tip depths, relative to the largest, up to which a tree is ultrametric.
SPREAD = 1e-8
#: Places along a tree that a running count goes over in one task.
STRETCH = 4_096


def summary(edges: DataFrame, spread: float = SPREAD) -> DataFrame:
    """tree_id, n_tips, root_age, total_pd, ultrametric, degenerate."""
    tip = F.col("is_tip")
    return edges.groupBy("tree_id").agg(
        F.count_if(tip).alias("n_tips"),
        F.max(F.when(tip, F.col("d"))).alias("root_age"),
        F.sum("length").alias("total_pd"),
        (F.max(F.when(tip, F.col("d"))) - F.min(F.when(tip, F.col("d"))) <= F.lit(spread) * F.max(F.when(tip, F.col("d")))).alias("ultrametric"),
        ((F.max(F.when(tip, F.col("d"))) <= 0) | (F.sum("length") <= 0)).alias("degenerate"),
    )


def require(edges: DataFrame, allow_non_ultrametric: bool = False) -> DataFrame:
    """edges, or a ValueError where a tree has no depth or no length, or isn't ultrametric (unless that is
    allowed). One row for each tree is looked at."""
    bad = summary(edges).where("degenerate OR degenerate IS NULL OR NOT ultrametric").select("tree_id", "degenerate").limit(20).collect()
    if any(r.degenerate is not False for r in bad):
        raise ValueError(f"trees without depth or length: {sorted(str(r.tree_id) for r in bad if r.degenerate is not False)[:5]}")
    if bad and not allow_non_ultrametric:
        raise ValueError(f"trees that are not ultrametric: {sorted(str(r.tree_id) for r in bad)[:5]}; allow_non_ultrametric takes them as they are")
    return edges


def usable(edges: DataFrame, allow_non_ultrametric: bool = False) -> DataFrame:
    """edges of the trees that `require` takes; for pools, where a bad tree costs its own draw."""
    fine = summary(edges).where("NOT degenerate" if allow_non_ultrametric else "NOT degenerate AND ultrametric")
    return edges.join(fine.select("tree_id"), "tree_id", "left_semi")


def with_lengths(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """edges with the lengths of (tree_id, edge_id, length); an edge that has none there is an error. Depths
    stay those of the tree that was cut."""
    found = edges.drop("length").join(lengths.select("tree_id", "edge_id", "length"), ["tree_id", "edge_id"], "left")
    known = F.coalesce("length", F.raise_error(F.concat(F.lit("no length for edge "), F.col("edge_id").cast("string"))).cast("double"))
    return found.withColumn("length", known).select(*edges.columns)


def tip_ages(edges: DataFrame) -> DataFrame:
    return edges.where("is_tip").join(summary(edges).select("tree_id", "root_age"), "tree_id").select("tree_id", "label", (F.col("root_age") - F.col("d")).alias("age"))


def closure(edges: DataFrame) -> DataFrame:
    """tree_id, tip, label, edge_id: an edge with each tip below it; an equi-join key for membership."""
    tips = edges.where("is_tip").select("tree_id", F.col("tip_lo").alias("tip"), "label")
    below = edges.select("tree_id", "edge_id", F.explode(F.sequence(F.col("tip_lo"), F.col("tip_hi") - 1)).alias("tip"))
    return below.join(tips, ["tree_id", "tip"]).select("tree_id", "tip", "label", "edge_id")


def heavy_paths(edges: DataFrame, inner: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trees cut into paths from which most tips never turn off: below each node the child with most tips goes
    on, and every other edge, a light one, heads a path of its own. A tip is below as many light edges as its tree's
    size has binary digits at most, however deep the tree is.

    Returns (tree_id, path, edge_id, size) of every edge, and (tree_id, tip, label, path, reach): the edges of a path
    that are above a tip are those of at least reach tips. path: the edge at the head, null for that of the root.
    inner: without tips' own edges, and the paths that these head; a tip's edge may still end one of the paths.
    """
    size = F.col("tip_hi") - F.col("tip_lo")
    first = F.row_number().over(Window.partitionBy("tree_id", "parent").orderBy(F.desc("size"), "tip_lo", "edge_id"))
    # What the parent's own edge holds; nothing is above the root.
    above = edges.where("NOT is_tip").select("tree_id", F.col("child").alias("parent"), size.alias("holds"))
    marked = edges.withColumn("size", size).withColumn("light", first > 1).join(above, ["tree_id", "parent"], "left").withColumn("holds", F.coalesce("holds", F.lit(2**62)))
    light = marked.where("light AND NOT is_tip" if inner else "light")
    under = light.select("tree_id", F.explode(F.sequence(F.col("tip_lo"), F.col("tip_hi") - 1)).alias("tip"), "label", F.col("edge_id").alias("path"), "size", "holds", F.lit(0).cast("long").alias("least"))
    # Where a tip's own light edge isn't among them, the tip knows where it leaves the last path.
    least = F.when(F.col("light") & F.lit(inner), F.col("holds")).otherwise(F.lit(0)).cast("long")
    top = F.lit(2**62)
    under = under.unionByName(marked.where("is_tip").select("tree_id", F.col("tip_lo").alias("tip"), "label", F.lit(None).cast(edges.schema["edge_id"].dataType).alias("path"), top.alias("size"), top.alias("holds"), least.alias("least")))
    # A tip leaves a path at the node where the next light edge above it begins.
    tip = Window.partitionBy("tree_id", "tip")
    below = under.withColumn("reach", F.coalesce(F.lead("holds").over(tip.orderBy(F.desc("size"))), F.max("least").over(tip)))
    heads = under.select("tree_id", F.col("tip").alias("tip_lo"), "path", F.col("size").alias("head"))
    own = (edges.where("NOT is_tip") if inner else edges).select("tree_id", "edge_id", "tip_lo", size.alias("size")).join(heads, ["tree_id", "tip_lo"]).where("head >= size")
    paths = own.groupBy("tree_id", "edge_id").agg(F.min(F.struct("head", "path")).alias("h"), F.first("size").alias("size")).select("tree_id", "h.path", "edge_id", "size")
    return paths, below.select("tree_id", "tip", F.max("label").over(tip).alias("label"), "path", "reach")


def tip_intervals(pairs: DataFrame) -> DataFrame:
    """tree_id, edge_id, tip_lo, tip_hi of a closure."""
    return pairs.groupBy("tree_id", "edge_id").agg(F.min("tip").alias("tip_lo"), (F.max("tip") + 1).alias("tip_hi"))


def children_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tree_id", "parent").agg(F.sort_array(F.collect_list("child")).alias("children"))


def _jumps(links: DataFrame) -> DataFrame:
    """tree_id, node, top, depth, open: each node's last ancestor that pointer doubling reaches, in as many
    rounds as the logarithm of the largest tree's size. open: it goes on from there, which only a cycle makes
    possible. Of several parents of a node, the smallest counts."""
    up = links.groupBy("tree_id", F.col("child").alias("node")).agg(F.min(F.struct(F.col("parent").alias("top"), F.col("length").alias("depth"))).alias("s")).select("tree_id", "node", "s.top", "s.depth")
    most = links.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for k in range(int(most).bit_length() + 1):
        over = up.select("tree_id", F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        new = up.join(over, ["tree_id", "top"], "left").select("tree_id", "node", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0.0))).alias("depth"), F.col("next").isNotNull().alias("open"))
        new = settle(new)
        up = new.drop("open")
        if not new.where("open").limit(1).count():
            break
    return new if most else up.withColumn("open", F.lit(False))


def node_depths(links: DataFrame) -> DataFrame:
    """tree_id, node, depth from (tree_id, parent, child, length) by pointer doubling: as many rounds as
    the logarithm of the height. The root has depth 0; nodes that aren't below a root, such as those of a cycle,
    don't come out."""
    up = _jumps(links).where("NOT open")
    roots = up.select("tree_id", F.col("top").alias("node")).distinct().withColumn("depth", F.lit(0.0))
    return up.select("tree_id", "node", "depth").unionByName(roots)


def reachable(links: DataFrame) -> DataFrame:
    """tree_id, node of the nodes that can be reached from a root, roots included."""
    return node_depths(links).select("tree_id", "node")


def problems(links: DataFrame) -> DataFrame:
    """tree_id, problem of edge tables (tree_id, parent, child, length, label) that aren't trees: lengths that
    are negative or not finite, nodes with several parents, labels of tips that repeat or are null, fewer than
    two tips, several roots or none, nodes that no root reaches."""
    tips = links.join(links.select("tree_id", F.col("parent").alias("child")).distinct(), ["tree_id", "child"], "left_anti")
    found = [
        links.where(F.col("length").isNull() | F.isnan("length") | (F.abs("length") == float("inf"))).select("tree_id", F.lit("length not finite").alias("problem")),
        links.where("length < 0").select("tree_id", F.lit("negative length").alias("problem")),
        links.groupBy("tree_id", "child").count().where("count > 1").select("tree_id", F.lit("more than one parent").alias("problem")),
        tips.groupBy("tree_id", "label").count().where("count > 1 OR label IS NULL").select("tree_id", F.lit("labels not unique").alias("problem")),
        tips.groupBy("tree_id").count().where("count < 2").select("tree_id", F.lit("fewer than two tips").alias("problem")),
        links.select("tree_id", F.col("parent").alias("node")).distinct().join(links.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti").groupBy("tree_id").count().where("count <> 1").select("tree_id", F.lit("more than one root").alias("problem")),
        links.select("tree_id").distinct().join(links.select("tree_id", F.col("parent").alias("node")).join(links.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti").select("tree_id").distinct(), "tree_id", "left_anti").select("tree_id", F.lit("no root").alias("problem")),
        _jumps(links.withColumn("length", F.lit(0.0))).where("open").select("tree_id", F.lit("not reachable from a root").alias("problem")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def prune(edges: DataFrame, keep: DataFrame, leave_whole: bool = False) -> DataFrame:
    """edges of each tree over the tips in keep (tree_id, label; or label, for all trees; or what kept_tips has of
    them, which is read several times), and nothing above their last common ancestor. Depths and tip numbers start anew; nodes of one child stay. Trees of under two kept tips
    don't come out. leave_whole: trees that keep all tips stay as they are.

    Kept tips are counted along the tree, so an edge's count is a difference of two running counts,
    and no tip is paired with the edges above it. Only tips' numbers go through the join with keep.
    """
    tips, inner = edges.where("is_tip"), edges.where("NOT is_tip")
    kept = (keep if "tip_lo" in keep.columns else settle(kept_tips(edges, keep))).withColumnRenamed("tip_lo", "_at")
    sizes = tips.groupBy("tree_id").agg(F.count("*").alias("_tips"))
    edge = F.struct(*edges.columns).alias("_edge")
    own = _counted(tips.select("tree_id", F.col("tip_lo").alias("_at"), F.lit(2).alias("_turn"), edge), kept, sizes).where("_here")
    own = own.select("_edge", (F.col("_n") - 1).alias("_lo"), F.col("_n").alias("_hi"), "_all", "_tips")
    held = _spans(inner.select("tree_id", "tip_lo", "tip_hi", edge), kept, sizes).where("_hi > _lo")
    whole = (F.col("_all") == F.col("_tips")) if leave_whole else F.lit(False)
    # Edges that hold all kept tips are above their last common ancestor.
    stem = (F.col("_hi") - F.col("_lo") == F.col("_all")) & ~whole
    stems = held.where(stem).groupBy(F.col("_edge.tree_id").alias("tree_id")).agg(F.max("_edge.d").alias("_stem"))
    left = own.unionByName(held.where(~stem)).where("_all >= 2").select("_edge.*", "_lo", "_hi")
    left = left.join(F.broadcast(stems), "tree_id", "left").withColumn("_stem", F.coalesce("_stem", F.lit(0.0)))
    return left.withColumns({"b": F.col("b") - F.col("_stem"), "d": F.col("d") - F.col("_stem"), "tip_lo": F.col("_lo"), "tip_hi": F.col("_hi")}).select(*edges.columns)


def kept_tips(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """tree_id, tip_lo of the tips in keep (tree_id, label; or label, for all trees)."""
    on = [c for c in ("tree_id", "label") if c in keep.columns]
    return edges.where("is_tip").select("tree_id", "label", "tip_lo").join(keep.select(*on).distinct(), on, "left_semi").select("tree_id", "tip_lo")


def _counted(rows: DataFrame, marks: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """rows (tree_id, _at, _turn and others) with _n, how many marks (tree_id, _at, each once) of their tree stand
    before them, _here, whether one stands just before, and _all, how many there are. A mark's turn at its place is 1.
    more: other columns of trees. Counts run within stretches of STRETCH places, to which what
    stands before them is added, so that a tree isn't one task.
    """
    both = rows.withColumn("_mark", F.lit(0)).unionByName(marks.select("tree_id", "_at", F.lit(1).alias("_turn"), F.lit(1).alias("_mark")), allowMissingColumns=True).withColumn("_stretch", F.floor(F.col("_at") / STRETCH))
    tree, sums = Window.partitionBy("tree_id"), both.groupBy("tree_id", "_stretch").agg(F.sum("_mark").alias("_k"))
    earlier = F.sum("_k").over(tree.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("tree_id", "_stretch", F.coalesce(earlier, F.lit(0)).alias("_offset"), F.sum("_k").over(tree).alias("_all"))
    sums = sums if more is None else sums.join(more, "tree_id")
    along = Window.partitionBy("tree_id", "_stretch").orderBy("_at", "_turn")
    counts = both.withColumn("_n", F.sum("_mark").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_here", F.coalesce(F.lag("_mark").over(along) == 1, F.lit(False)))
    return counts.where("_mark = 0").join(sums, ["tree_id", "_stretch"]).withColumn("_n", F.col("_offset") + F.col("_n")).drop("_mark", "_stretch", "_offset")


def _spans(rows: DataFrame, marks: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """_edge, _lo, _hi, _all (and more) of rows (tree_id, tip_lo, tip_hi, _edge): how many marks stand before the first
    and up to the last of its tips."""
    ends = F.array(F.struct(F.col("tip_lo").alias("_at"), F.lit(0).alias("_turn")), F.struct((F.col("tip_hi") - 1).alias("_at"), F.lit(3).alias("_turn")))
    found = _counted(rows.select("tree_id", "_edge", F.inline(ends)), marks, more)
    extra = [] if more is None else [c for c in more.columns if c != "tree_id"]
    return found.groupBy("tree_id", F.col("_edge.edge_id").alias("_id")).agg(F.first("_edge").alias("_edge"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), *(F.first(c).alias(c) for c in ("_all", *extra))).drop("tree_id", "_id")


def lean(edges: DataFrame) -> DataFrame:
    """The inner edges, and of the tips of each node only the first, numbered anew, with nothing but its parent.
    All tips of a node are below the same edges, so that this is enough to tell which. Checkpointed."""
    first = edges.where("is_tip").groupBy("tree_id", "parent").agg(F.min("tip_lo").alias("_at"))
    spans = _spans(edges.where("NOT is_tip").select("tree_id", "tip_lo", "tip_hi", F.struct(*edges.columns).alias("_edge")), first.drop("parent"))
    inner = spans.select("_edge.*", "_lo", "_hi").withColumns({"tip_lo": F.col("_lo"), "tip_hi": F.col("_hi")}).select(*edges.columns)
    tips = _counted(first.withColumn("_turn", F.lit(2)), first.drop("parent")).select("tree_id", "parent", (F.col("_n") - 1).alias("tip_lo"), F.col("_n").alias("tip_hi"), F.lit(True).alias("is_tip"))
    return settle(inner.unionByName(tips, allowMissingColumns=True))


def collapse(edges: DataFrame, by: tuple[str, ...] = ("tree_id",)) -> DataFrame:
    """edges without inner edges of length 0; their children hang on the nearest node that is left.
    Tip edges of length 0 stay."""
    key = list(by)
    gone = F.col("length").eqNullSafe(0.0) & ~F.col("is_tip")
    jumps = edges.where(gone).select(*key, F.col("child").alias("parent"), F.col("parent").alias("top"))
    left = edges.where(~gone)
    while jumps.limit(1).count():
        hop = left.join(jumps, [*key, "parent"], "left").withColumn("moved", F.col("top").isNotNull()).withColumn("parent", F.coalesce("top", "parent")).drop("top")
        hop = settle(hop)
        left = hop.drop("moved")
        if not hop.where("moved").limit(1).count():
            break
    return left.select(*edges.columns)


def slice_pd(edges: DataFrame, by: tuple[str, ...] = ("tree_id",)) -> DataFrame:
    return edges.groupBy(*by).agg(F.sum("length").alias("pd"))


def length_hash(edges: DataFrame) -> DataFrame:
    """tree_id, hash: SHA-256 of the positive lengths, sorted, with ten decimals, comma-joined."""
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("length") > 0, F.col("length")))), lambda x: F.format_string("%.10f", x))
    return edges.groupBy("tree_id").agg(F.sha2(F.array_join(texts, ",").cast("binary"), 256).alias("hash"))
