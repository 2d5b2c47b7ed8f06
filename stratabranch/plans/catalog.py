"""Registered queries of the tree engine and the SQL that each must agree with.

Numbers are rounded to six decimals on both sides, since sums are added in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabranch.functions import fit, stats
from stratabranch.operators import beta, indices, posterior, rates, slicing, spatial, trees
from stratabranch.plans import demo, sql
from stratabranch.session import table
from stratabranch.sources import newick, presence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Slices that the queries cut trees into, and the sizes of pools.
N, FITTED, DRAWS = 5, 10, 12


def register(oracle: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return keep


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


EDGE_ROWS = "SELECT edge_id, b, d, d - b AS length, tip_lo, tip_hi, is_tip, label FROM edges"


@register(sql.query(sql.tips(), "SELECT label, is_tip, b, d, d - b AS length, tip_hi - tip_lo AS n_tips FROM edges"))
def newick_parse(spark, sf):
    """Trees rendered as text, then parsed again."""
    texts = newick.render_trees(demo.numbered(demo.edges(spark, sf)))
    found, _ = newick.parse_trees(texts)
    return rounded(found.select("label", "is_tip", "b", "d", "length", (F.col("tip_hi") - F.col("tip_lo")).alias("n_tips")))


@register(sql.query(sql.tips(3), "SELECT tree_id || '.' || k AS tree_id, count(*) FILTER (WHERE is_tip) AS n_tips, max(d) AS root_age, sum(d - b) AS total_pd FROM edges, (SELECT unnest(range(2)) AS k) GROUP BY tree_id, k"))
def newick_pool(spark, sf):
    """Texts of two records, with a comment and a quoted label between, split and parsed by the UDTFs."""
    newick.register(spark)
    texts = newick.render_trees(demo.numbered(demo.edges(spark, sf, 3)))
    texts.withColumn("text", F.concat("newick", F.lit(" [a comment; of two parts]\n"), "newick")).createOrReplaceTempView("_pool_text")
    rows = spark.sql("SELECT concat(tree_id, '.', draw) AS tree_id, e.* FROM (SELECT p.tree_id, r.draw, r.newick FROM _pool_text p, LATERAL split_newick(p.text) r), LATERAL parse_newick(newick) e")
    return rounded(trees.summary(rows).select("tree_id", "n_tips", "root_age", "total_pd"))


LADDER_NODES = "SELECT tree_id, edge_id AS node, d AS depth FROM ladders UNION ALL SELECT DISTINCT tree_id, 'n0', CAST(0 AS DOUBLE) FROM ladders"


@register(sql.query(sql.tips(2), sql.LADDERS, f"SELECT tree_id, edge_id AS node, d AS depth FROM edges UNION ALL SELECT DISTINCT tree_id, 'root', CAST(0 AS DOUBLE) FROM edges UNION ALL {LADDER_NODES}"))
def node_depth(spark, sf):
    columns = ("tree_id", "parent", "child", "length")
    return trees.node_depths(demo.edges(spark, sf, 2).select(*columns).union(demo.ladders(spark, sf).select(*columns)))


@register(sql.query(sql.tips(), "SELECT edge_id, min(tip) AS tip_lo, max(tip) + 1 AS tip_hi FROM closure GROUP BY edge_id"))
def tip_intervals(spark, sf):
    return trees.tip_intervals(trees.closure(demo.edges(spark, sf))).drop("tree_id")


@register(sql.query(sql.tips(), "SELECT parent, list(edge_id ORDER BY edge_id) AS children FROM edges GROUP BY parent"))
def children_of(spark, sf):
    return trees.children_of(demo.edges(spark, sf)).drop("tree_id")


ALL_TREES = "everything AS (SELECT tree_id, b, d, is_tip FROM edges UNION ALL SELECT tree_id, b, d, is_tip FROM ladders UNION ALL SELECT 'flat' || tree_id, 0, 0, is_tip FROM ladders)"


@register(sql.query(sql.tips(3), sql.LADDERS, ALL_TREES, "SELECT tree_id, count(*) FILTER (WHERE is_tip) AS n_tips, max(d) FILTER (WHERE is_tip) AS root_age, sum(d - b) AS total_pd, max(d) FILTER (WHERE is_tip) - min(d) FILTER (WHERE is_tip) <= 1e-8 * max(d) FILTER (WHERE is_tip) AS ultrametric, max(d) FILTER (WHERE is_tip) <= 0 OR sum(d - b) <= 0 AS degenerate FROM everything GROUP BY tree_id"))
def ultrametric_check(spark, sf):
    """Pools, ladders that mostly aren't ultrametric, and ladders without any length."""
    ladders = demo.ladders(spark, sf)
    flat = ladders.withColumns({"tree_id": F.concat(F.lit("flat"), "tree_id"), "b": F.lit(0.0), "d": F.lit(0.0), "length": F.lit(0.0)})
    return rounded(trees.summary(demo.edges(spark, sf, 3).unionByName(ladders).unionByName(flat)))


@register(sql.query(sql.LADDERS, "SELECT tree_id, label, max(d) FILTER (WHERE is_tip) OVER (PARTITION BY tree_id) - d AS age FROM ladders QUALIFY is_tip"))
def tip_ages(spark, sf):
    return rounded(trees.tip_ages(demo.ladders(spark, sf)))


# Links (kind, parent, child, length, label): a sound tree and one for each way not to be a tree.
_SOUND = [(9, 1, "1", "a"), (9, 2, "1", "b"), (9, 3, "1", "c")]
BROKEN = [
    _SOUND,
    [(9, 1, "NaN", "a"), *_SOUND[1:]],
    [(9, 1, "-1", "a"), *_SOUND[1:]],
    [*_SOUND, (3, 2, "1", "b")],
    [(9, 1, "1", "c"), *_SOUND[1:]],
    [(9, 1, "1", "a")],
    [*_SOUND, (8, 4, "1", "d")],
    [(9, 1, "1", None), (1, 9, "1", None)],
    [*_SOUND, (5, 6, "1", None), (6, 5, "1", None)],
    [(9, 1, "Infinity", "a"), *_SOUND[1:]],
    [*_SOUND, (3, 4, "1", None), (3, 5, "1", "e")],
]
_VALUES = ", ".join(f"({k}, {p}, {c}, '{x}', {'NULL' if l is None else repr(l)})" for k, rows in enumerate(BROKEN) for p, c, x, l in rows)
LINKS = f"""
cases AS (SELECT kind, parent, child, CAST(x AS DOUBLE) AS length, CAST(label AS VARCHAR) AS label FROM (VALUES {_VALUES}) v(kind, parent, child, x, label)),
links AS (SELECT 'p' || p_partkey AS tree_id, parent, child, length, label FROM part JOIN cases ON p_partkey % {len(BROKEN)} = kind),
tips AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM links m WHERE m.tree_id = l.tree_id AND m.parent = l.child)),
roots AS (SELECT DISTINCT tree_id, parent AS node FROM links l WHERE NOT EXISTS (SELECT 1 FROM links m WHERE m.tree_id = l.tree_id AND m.child = l.parent)),
reach AS (SELECT tree_id, node FROM roots UNION SELECT l.tree_id, l.child FROM reach r JOIN links l ON l.tree_id = r.tree_id AND l.parent = r.node)"""


def _links(spark, sf) -> DataFrame:
    """A small tree for each part."""
    cases = spark.createDataFrame([(k, p, c, float(x.replace("Infinity", "inf")), l) for k, rows in enumerate(BROKEN) for p, c, x, l in rows], "kind long, parent int, child int, length double, label string")
    part = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("tree_id"), (F.col("p_partkey") % len(BROKEN)).alias("kind"))
    return part.join(F.broadcast(cases), "kind").drop("kind")


@register(sql.query(LINKS, """
SELECT DISTINCT tree_id, 'length not finite' AS problem FROM links WHERE NOT isfinite(length)
UNION ALL SELECT DISTINCT tree_id, 'negative length' FROM links WHERE length < 0
UNION ALL SELECT DISTINCT tree_id, 'more than one parent' FROM links GROUP BY tree_id, child HAVING count(*) > 1
UNION ALL SELECT DISTINCT tree_id, 'labels not unique' FROM tips GROUP BY tree_id, label HAVING count(*) > 1 OR label IS NULL
UNION ALL SELECT tree_id, 'fewer than two tips' FROM tips GROUP BY tree_id HAVING count(*) < 2
UNION ALL SELECT tree_id, 'more than one root' FROM roots GROUP BY tree_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT tree_id, 'no root' FROM links WHERE tree_id NOT IN (SELECT tree_id FROM roots)
UNION ALL SELECT DISTINCT l.tree_id, 'not reachable from a root' FROM links l LEFT JOIN reach r ON r.tree_id = l.tree_id AND r.node = l.child WHERE r.node IS NULL
""", recursive=True))
def edge_problems(spark, sf):
    """Each part is a small tree, most of them broken; the broken ones are told with their problems."""
    return trees.problems(_links(spark, sf))


@register(sql.query(LINKS, "SELECT tree_id, node FROM reach", recursive=True))
def reachable_nodes(spark, sf):
    return trees.reachable(_links(spark, sf).withColumn("length", F.lit(1.0)))


@register(sql.query(sql.tips(), "SELECT edge_id, CAST(tip_hi - tip_lo AS DOUBLE) AS length FROM edges"))
def replaced_lengths(spark, sf):
    e = demo.edges(spark, sf)
    return trees.with_lengths(e, e.select("tree_id", "edge_id", (F.col("tip_hi") - F.col("tip_lo")).cast("double").alias("length"))).select("edge_id", "length")


@register(sql.query(sql.tips(), sql.windows(str(N)), sql.contribution(), "SELECT edge_id, j, round(c, 6) AS c FROM contribution"))
def contribution(spark, sf):
    e = demo.edges(spark, sf)
    return rounded(slicing.contribution(e, slicing.windows(e, N)).select("edge_id", "j", "c"))


def _slice(keep: str) -> str:
    return sql.query(sql.tips(), f"SELECT edge_id, round(greatest(0, {keep}), 6) AS length FROM edges")


def _cut(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("edge_id", "length"))


@register(_slice("d - greatest(b, 6)"))
def slice_rootward(spark, sf):
    return _cut(slicing.rootward(demo.edges(spark, sf), 4.0))


@register(_slice("least(d, 6) - b"))
def slice_tipward(spark, sf):
    return _cut(slicing.tipward(demo.edges(spark, sf), 4.0))


@register(_slice("least(d, 8) - greatest(b, 2)"))
def slice_interval(spark, sf):
    return _cut(slicing.interval(demo.edges(spark, sf), 8.0, 2.0))


@register(sql.query(sql.tips(), "SELECT 'older' AS side, edge_id, greatest(0, least(d, 2) - b) AS length FROM edges UNION ALL SELECT 'younger', edge_id, greatest(0, d - greatest(b, 8)) FROM edges"))
def slice_interval_invert(spark, sf):
    return rounded(slicing.interval(demo.edges(spark, sf), 8.0, 2.0, invert=True).select("side", "edge_id", "length"))


@register(sql.query(sql.tips(2), sql.windows("4"), "SELECT tree_id, j, edge_id, round(greatest(0, least(d, hi) - greatest(b, lo)), 6) AS length FROM edges JOIN windows USING (tree_id)"))
def slice_pieces_time(spark, sf):
    e = demo.edges(spark, sf, 2)
    return rounded(slicing.slices(e, slicing.windows(e, 4)).select("tree_id", "j", "edge_id", "length"))


CURVE = """
points AS (SELECT tree_id, depth, sum(step) AS step FROM (SELECT tree_id, b AS depth, 1 AS step FROM edges UNION ALL SELECT tree_id, d, -1 FROM edges) GROUP BY ALL),
pieces AS (
  SELECT *, sum(active * (next_depth - depth)) OVER (PARTITION BY tree_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS pd_hi
  FROM (SELECT tree_id, depth, lead(depth) OVER w AS next_depth, sum(step) OVER w AS active FROM points WINDOW w AS (PARTITION BY tree_id ORDER BY depth))
  WHERE next_depth IS NOT NULL
),
curve AS (SELECT tree_id, depth, next_depth, CAST(active AS BIGINT) AS active, pd_hi - active * (next_depth - depth) AS pd_lo, pd_hi FROM pieces)"""

CUTS = CURVE + """,
whole AS (SELECT tree_id, max(pd_hi) AS total, max(next_depth) AS t FROM curve GROUP BY tree_id),
cuts AS (
  SELECT w.tree_id, j, t, CASE WHEN j = 0 THEN 0 WHEN j = {n} THEN t ELSE (
    SELECT depth + (total * j / {n} - pd_lo) / active FROM curve c WHERE c.tree_id = w.tree_id AND pd_lo < total * j / {n} AND total * j / {n} <= pd_hi
  ) END AS lo FROM whole w, (SELECT unnest(range({n} + 1)) AS j)
)"""


@register(sql.query(sql.tips(2), CURVE, "SELECT tree_id, depth, next_depth, active, round(pd_lo, 6) AS pd_lo, round(pd_hi, 6) AS pd_hi FROM curve"))
def pd_depth_curve(spark, sf):
    return rounded(slicing.pd_curve(demo.edges(spark, sf, 2)))


@register(sql.query(sql.tips(2), CUTS.format(n=N), "SELECT * FROM (SELECT tree_id, j, round(lo, 6) AS lo, round(lead(lo) OVER (PARTITION BY tree_id ORDER BY j), 6) AS hi, round(t - lo, 6) AS age FROM cuts) WHERE hi IS NOT NULL"))
def slice_pieces_pd(spark, sf):
    return rounded(slicing.windows(demo.edges(spark, sf, 2), N, criterion="pd"))


@register(sql.query(sql.tips(), CURVE, "SELECT edge_id, round(greatest(0, d - greatest(b, place)), 6) AS length FROM edges, (SELECT depth + (30 - pd_lo) / active AS place FROM curve WHERE pd_lo < 30 AND 30 <= pd_hi)"))
def slice_rootward_pd(spark, sf):
    return _cut(slicing.rootward(demo.edges(spark, sf), 30.0, "pd"))


@register("SELECT p_partkey, CASE WHEN width = total THEN 1 WHEN abs(width - total / floor(total / width)) < abs(width - total / ceil(total / width)) AND floor(total / width) <> 1 THEN CAST(floor(total / width) AS BIGINT) ELSE CAST(ceil(total / width) AS BIGINT) END AS n_slices FROM (SELECT p_partkey, p_retailprice AS total, CASE WHEN p_size % 10 = 0 THEN p_retailprice ELSE p_retailprice / (1 + p_size / 7.0e0) END AS width FROM part)")
def slice_widths(spark, sf):
    """How many slices a wanted width gives, for every part's price as a whole."""
    part = table(spark, sf, "part")
    total = F.col("p_retailprice")
    width = F.when(F.col("p_size") % 10 == 0, total).otherwise(total / (1 + F.col("p_size") / 7.0))
    return part.select("p_partkey", slicing.piece_count(total, width).alias("n_slices"))


@register(sql.query(sql.tips(3), sql.windows("4"), "SELECT tree_id, j, round(lo, 6) AS lo, round(hi, 6) AS hi, round(age, 6) AS age FROM windows"))
def windows_by_width(spark, sf):
    """Ages of 10 by a width of 2.6: four slices of every tree."""
    return rounded(slicing.windows(demo.edges(spark, sf, 3), width=2.6))


PRUNED = """
keep AS (SELECT tree_id, label FROM {keep}),
kept AS (SELECT c.tree_id, c.edge_id, c.tip, c.label FROM closure c JOIN keep USING (tree_id, label)),
ranked AS (SELECT tree_id, edge_id, dense_rank() OVER (PARTITION BY tree_id ORDER BY tip) - 1 AS place FROM kept),
spans AS (SELECT tree_id, edge_id, min(place) AS tip_lo, max(place) + 1 AS tip_hi, count(*) AS n FROM ranked GROUP BY ALL),
alls AS (SELECT tree_id, max(place) + 1 AS n_all FROM ranked GROUP BY tree_id),
stems AS (SELECT tree_id, coalesce(max(CASE WHEN n = n_all THEN d END), 0) AS stem FROM edges JOIN spans USING (tree_id, edge_id) JOIN alls USING (tree_id) GROUP BY tree_id)"""
PRUNED_ROWS = "SELECT tree_id, edge_id, b - stem AS b, d - stem AS d, s.tip_lo, s.tip_hi FROM edges JOIN spans s USING (tree_id, edge_id) JOIN alls USING (tree_id) JOIN stems USING (tree_id) WHERE n < n_all AND n_all >= 2"


def _pruned(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("tree_id", "edge_id", "b", "d", "tip_lo", "tip_hi"))


@register(sql.query(sql.tips(2), PRUNED.format(keep="tips WHERE p_partkey % 3 = 1"), PRUNED_ROWS))
def subarray_prune(spark, sf):
    e = demo.edges(spark, sf, 2)
    keep = e.where("is_tip").where(F.substring("label", 2, 20).cast("long") % 3 == 1).select("tree_id", "label")
    return _pruned(trees.prune(e, keep))


LADDER_PRUNED = "SELECT tree_id, edge_id, round(b - stem, 6) AS b, round(d - stem, 6) AS d, s.tip_lo, s.tip_hi FROM ladders JOIN spans s USING (tree_id, edge_id) JOIN alls USING (tree_id) JOIN stems USING (tree_id) WHERE n < n_all AND n_all >= 2"


@register(sql.query(sql.LADDERS, "closure AS (SELECT e.tree_id, e.edge_id, t.tip_lo AS tip, t.label FROM ladders e JOIN ladders t ON t.tree_id = e.tree_id AND t.is_tip AND t.tip_lo >= e.tip_lo AND t.tip_lo < e.tip_hi)", PRUNED.format(keep="ladders WHERE is_tip AND tip_lo % 4 > 1").replace("FROM edges", "FROM ladders"), LADDER_PRUNED))
def prune_ladders(spark, sf):
    """Two tips of four stay, not the first ones: stems go, and inner nodes of one child remain."""
    e = demo.ladders(spark, sf)
    return _pruned(trees.prune(e, e.where("is_tip AND tip_lo % 4 > 1").select("tree_id", "label")))


@register(sql.query(sql.tips(), PRUNED.format(keep="tips WHERE p_type = 'SMALL'"), PRUNED_ROWS))
def subarray_below_root(spark, sf):
    """Tips of one type: the root moves down to their last common ancestor."""
    e = demo.edges(spark, sf)
    keep = e.where("is_tip AND parent LIKE 'B:SMALL:%'").select("tree_id", "label")
    return _pruned(trees.prune(e, keep))


@register(sql.query(sql.tips(), PRUNED.format(keep="tips WHERE 10 - db >= 6"), PRUNED_ROWS))
def prune_tips(spark, sf):
    return _pruned(slicing.prune_tips(demo.edges(spark, sf), threshold=6.0))


@register(sql.query(sql.tips(), PRUNED.format(keep="tips WHERE 10 - db < (SELECT quantile_cont(10 - db, 0.5) FROM tips)"), PRUNED_ROWS))
def prune_tips_quantile(spark, sf):
    return _pruned(slicing.prune_tips(demo.edges(spark, sf), quantile=0.5, side="before"))


@register(sql.query(sql.tips(), sql.windows(str(N)), "SELECT j, round(sum(greatest(0, least(d, hi) - greatest(b, lo))), 6) AS c FROM edges JOIN windows USING (tree_id) WHERE edge_id IN (SELECT edge_id FROM closure WHERE label LIKE '%7') AND d > lo AND b < hi GROUP BY j"))
def subset_contribution(spark, sf):
    e = demo.edges(spark, sf)
    return rounded(slicing.subset_contribution(e, slicing.windows(e, N), e.where("is_tip AND label LIKE '%7'")).drop("tree_id"))


@register(sql.query(sql.tips(), "SELECT edge_id, CASE WHEN is_tip AND dt = 2 THEN 'T:' || p_type ELSE parent END AS parent FROM (SELECT e.*, t.dt, t.p_type FROM edges e LEFT JOIN tips t ON t.label = e.label) WHERE NOT (edge_id LIKE 'B:%' AND b = 2)"))
def collapse_edges(spark, sf):
    """Brand nodes below depth 2 get length 0; their tips hang on the type."""
    e = demo.edges(spark, sf)
    zero = e.withColumn("length", F.when(F.col("edge_id").startswith("B:") & (F.col("b") == 2), 0.0).otherwise(F.col("length")))
    return trees.collapse(zero).select("edge_id", "parent")


@register(sql.query(sql.tips(3), "SELECT tree_id, sha256(string_agg(printf('%.10f', d - b), ',' ORDER BY d - b)) AS hash FROM edges GROUP BY tree_id"))
def length_hash(spark, sf):
    return trees.length_hash(demo.edges(spark, sf, 3))


@register(sql.query(sql.tips(), sql.windows("4"), "SELECT j, round(sum(greatest(0, least(d, hi) - greatest(b, lo))), 6) AS pd FROM edges JOIN windows USING (tree_id) GROUP BY j"))
def slice_pd(spark, sf):
    e = demo.edges(spark, sf)
    return rounded(trees.slice_pd(slicing.slices(e, slicing.windows(e, 4)), ("j",)))


ALIGN = """
n AS (SELECT t.tree_id, count(*) AS n_tips, count(s.species) AS shared FROM tips t LEFT JOIN (SELECT DISTINCT species FROM presence) s ON s.species = t.label GROUP BY t.tree_id),
k AS (SELECT count(DISTINCT species) AS n_species FROM presence)"""


@register(sql.query(sql.tips(2), sql.PRESENCE, ALIGN, "SELECT tree_id, unnest(['pruned_tips', 'dropped_species', 'shared', 'rejected']) AS action, unnest([n_tips - shared, n_species - shared, shared, CAST(shared < 2 AS BIGINT)]) AS n FROM n, k"))
def align_report(spark, sf):
    return indices.align(demo.edges(spark, sf, 2), demo.presence(spark, sf))[2]


@register(sql.query(sql.tips(), sql.PRESENCE, sql.ALIGNED, "SELECT edge_id, b, d FROM aligned"))
def align_trees(spark, sf):
    return rounded(indices.align(demo.edges(spark, sf), demo.presence(spark, sf))[0].select("edge_id", "b", "d"))


@register(sql.query(sql.tips(), sql.PRESENCE, ALIGN, "SELECT tree_id, n_tips - shared AS missing, n_species - shared AS extra FROM n, k"))
def column_match(spark, sf):
    return indices.unmatched(demo.edges(spark, sf), demo.presence(spark, sf))


@register("SELECT s_nationkey AS site_id, 'p' || l_partkey AS species FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING max(l_quantity) > 10")
def presence_long(spark, sf):
    """Long rows with a value: present where the largest is over the threshold."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("site_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("species"), (F.col("l_quantity") - 10).alias("value"))
    return presence.from_long(rows, "site_id", "species", "value").select("site_id", "species")


@register("SELECT s_nationkey AS site_id, " + ", ".join(f"CAST(max(CASE WHEN p_brand = 'Brand#{k}' THEN 1 ELSE 0 END) AS INTEGER) AS brand_{k}" for k in range(1, 6)) + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_nationkey")
def presence_wide_pivot(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, sf, "part").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("brand_")).alias("species"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_nationkey").alias("site_id"), "species")
    return presence.to_wide(rows, [f"brand_{k}" for k in range(1, 6)])


@register("SELECT CAST(n_nationkey AS VARCHAR) AS site_id, 'k' || k AS species FROM nation, (SELECT unnest(range(1, 5)) AS k) WHERE n_nationkey % (k + 1) > 0")
def presence_unpivot(spark, sf):
    """A wide table to long rows."""
    wide = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("site_id"), *((F.col("n_nationkey") % (k + 1)).cast("double").alias(f"k{k}") for k in range(1, 5)))
    return presence.from_wide(wide, "site_id")


MEMBERS = (sql.tips(), sql.PRESENCE, sql.member())


@register(sql.query(*MEMBERS, "SELECT site_id, edge_id FROM member"))
def membership(spark, sf):
    return indices.membership(demo.edges(spark, sf), demo.presence(spark, sf)).drop("tree_id")


@register(sql.query(*MEMBERS, "SELECT edge_id, n FROM ranges"))
def edge_range_sizes(spark, sf):
    return indices.edge_ranges(indices.membership(demo.edges(spark, sf), demo.presence(spark, sf))).drop("tree_id")


TOTALS = "FROM member m JOIN edges e USING (tree_id, edge_id) JOIN ranges r USING (tree_id, edge_id) GROUP BY m.site_id"


@register(sql.query(*MEMBERS, f"SELECT m.site_id, round(sum(d - b), 6) AS pd {TOTALS}"))
def pd_total(spark, sf):
    return rounded(indices.totals(demo.edges(spark, sf), demo.presence(spark, sf)).select("site_id", "pd"))


@register(sql.query(*MEMBERS, f"SELECT m.site_id, round(sum((d - b) / n), 6) AS pe {TOTALS}"))
def pe_total(spark, sf):
    return rounded(indices.totals(demo.edges(spark, sf), demo.presence(spark, sf)).select("site_id", "pe"))


SLICED = (*MEMBERS, sql.windows(str(N)), sql.contribution(), sql.PROFILE)


def _profiles(spark, sf) -> DataFrame:
    return rates.site_profiles(demo.edges(spark, sf), demo.presence(spark, sf), N)


@register(sql.query(*SLICED, "SELECT site_id, j, round(pd, 6) AS pd FROM profile"))
def pd_per_slice(spark, sf):
    return rounded(_profiles(spark, sf).select("site_id", "j", "pd"))


@register(sql.query(*SLICED, "SELECT site_id, j, round(pe, 6) AS pe FROM profile"))
def pe_per_slice(spark, sf):
    return rounded(_profiles(spark, sf).select("site_id", "j", "pe"))


@register(sql.query(*SLICED, "SELECT site_id, j, round(sum(pd), 6) AS pd, grouping(site_id, j) AS level FROM profile GROUP BY ROLLUP (site_id, j)"))
def profile_rollup(spark, sf):
    """Slices, sites and everything in one pass: a site's slices add up to its total."""
    return rounded(_profiles(spark, sf).rollup("site_id", "j").agg(F.sum("pd").alias("pd"), F.grouping_id().alias("level")))


@register(sql.query(*SLICED, "SELECT site_id, j, round(pe / nullif(sum(pe) OVER s, 0), 6) AS share, round(sum(pe) OVER (s ORDER BY j ROWS UNBOUNDED PRECEDING) / nullif(sum(pe) OVER s, 0), 6) AS cumulative, CASE WHEN sum(pe) OVER s > 0 THEN 'ok' ELSE 'empty_site' END AS status FROM profile WINDOW s AS (PARTITION BY site_id)"))
def rate_profile_norm(spark, sf):
    return rounded(indices.normalised(_profiles(spark, sf), "pe").select("site_id", "j", "share", "cumulative", "status"))


ALIGNED = (sql.PRESENCE, sql.ALIGNED, sql.member("aligned"))


def _fitted(value: str, draws: int = 1, n: int = FITTED) -> tuple[str, ...]:
    return (sql.tips(draws), *ALIGNED, sql.windows(str(n), "aligned"), sql.contribution("aligned"), sql.PROFILE, sql.fit("profile", "tree_id, site_id", value))


def _rate(names: tuple[str, str, str]) -> str:
    return f"SELECT site_id, round(rate, 6) AS {names[0]}, round(total, 6) AS {names[1]}, round({sql.ORIGIN}, 6) AS {names[2]}, converged, round(r_squared, 6) AS r_squared, coalesce({sql.ORIGIN} <= t, true) AS origin_within_tree FROM fits JOIN ages USING (tree_id)"


RATE_COLUMNS = ("converged", "r_squared", "origin_within_tree")


@register(sql.query(*_fitted("pd"), _rate(("CpD", "PD", "pDO")), recursive=True))
def cpd_rate(spark, sf):
    return rounded(rates.cpd_rate(demo.edges(spark, sf), demo.presence(spark, sf), FITTED).select("site_id", "CpD", "PD", "pDO", *RATE_COLUMNS))


@register(sql.query(*_fitted("pe"), _rate(("CpE", "PE", "pEO")), recursive=True))
def cpe_rate(spark, sf):
    return rounded(rates.cpe_rate(demo.edges(spark, sf), demo.presence(spark, sf), FITTED).select("site_id", "CpE", "PE", "pEO", *RATE_COLUMNS))


@register(sql.query(*_fitted("pd"), "SELECT site_id, round(rate, 6) AS rate FROM fits", recursive=True))
def cpd_rate_native(spark, sf):
    """The same rates with the solver as a Catalyst expression."""
    edges, present, _ = indices.align(demo.edges(spark, sf), demo.presence(spark, sf))
    rows = indices.normalised(rates.site_profiles(edges, present, FITTED), "pd")
    whole = F.sort_array(F.collect_list(F.struct("j", "age", "cumulative")))
    arrays = rows.groupBy("site_id").agg(whole.alias("s"))
    return rounded(arrays.select("site_id", fit.rate_expression(F.col("s.age"), F.col("s.cumulative")).alias("rate")))


@register(sql.query(sql.tips(), *ALIGNED, sql.windows("4, 8, 16", "aligned"), sql.contribution("aligned"), sql.PROFILE, sql.fit("profile", "tree_id, site_id, n_slices", "pd"), "SELECT site_id, n_slices, round(rate, 6) AS rate, converged, min(pick) OVER (PARTITION BY site_id) AS suggested_slices FROM (SELECT *, CASE WHEN abs(rate - nxt) <= 0.05 * greatest(abs(nxt), 1e-12) THEN n_slices END AS pick FROM (SELECT *, lead(rate) OVER (PARTITION BY site_id ORDER BY n_slices) AS nxt FROM fits))", recursive=True))
def sensitivity(spark, sf):
    return rounded(rates.sensitivity(demo.edges(spark, sf), demo.presence(spark, sf), (4, 8, 16)).select("site_id", "n_slices", "rate", "converged", "suggested_slices"))


def _beta_parts(weighted: bool = False) -> tuple[str, ...]:
    return (sql.tips(), *ALIGNED, sql.PAIRS, sql.beta("aligned", weighted))


def _register_beta() -> None:
    for component in beta.COMPONENTS:
        for approach in beta.APPROACHES:
            for weighted in (False, True) if component == "sorensen" else (False,):
                _register_one(component, approach, weighted)


def _register_one(component: str, approach: str, weighted: bool) -> None:
    tail = ("cpb_rw" if weighted else f"cpb_{component}") + f"_{approach}"
    names = ("CpB_RW", "PB_RW") if weighted else ("CpB", "PB")
    series = (*_beta_parts(weighted), sql.beta_total(component, approach), sql.windows(str(FITTED), "aligned"), sql.contribution("aligned"), sql.beta_series(component, approach, weighted))

    def total(spark, sf):
        found = beta.totals(demo.edges(spark, sf), demo.presence(spark, sf), demo.adjacency(spark, sf), component, approach, weighted)
        return rounded(found.select("focal", "pb", "status"))

    def per_slice(spark, sf):
        found = beta.series(demo.edges(spark, sf), demo.presence(spark, sf), demo.adjacency(spark, sf), FITTED, component, approach, weighted)
        return rounded(found.select("focal", "j", "series", "value", "compatible", "total", "status"))

    def rate(spark, sf):
        found = rates.cpb_rate(demo.edges(spark, sf), demo.presence(spark, sf), demo.adjacency(spark, sf), FITTED, component, approach, weighted)
        return rounded(found.select("site_id", *names, "converged"))

    pb = tail.replace("cpb", "pb")
    register(sql.query(*_beta_parts(weighted), sql.beta_total(component, approach), "SELECT focal, CASE WHEN status = 'ok' THEN round(pb, 6) END AS pb, CASE WHEN status = 'ok' AND pb IS NULL THEN 'zero_denominator' ELSE status END AS status FROM total"), f"{pb.replace('pb', 'pb_total', 1)}")(total)
    ok = "CASE WHEN status = 'ok' THEN round({}, 6) END"
    register(sql.query(*series, f"SELECT focal, j, {ok.format('series')} AS series, {ok.format('series / nullif(row_sum, 0)')} AS value, {ok.format('series / nullif(pb, 0)')} AS compatible, {ok.format('pb')} AS total, status FROM rows_"), f"{pb.replace('pb', 'pb_slice', 1)}")(per_slice)
    known = "ok_rows AS (SELECT tree_id, focal, j, age, series / row_sum AS value FROM rows_ WHERE status = 'ok')"
    register(sql.query(*series, known, sql.fit("ok_rows", "tree_id, focal", "value"), f"SELECT r.focal AS site_id, round(any_value(f.rate), 6) AS {names[0]}, round(any_value(CASE WHEN r.status = 'ok' THEN r.pb END), 6) AS {names[1]}, any_value(coalesce(f.converged, false)) AS converged FROM rows_ r LEFT JOIN fits f ON f.focal = r.focal GROUP BY r.focal", recursive=True), tail)(rate)


_register_beta()


@register(sql.query(*_beta_parts(), sql.beta_total("sorensen", "multisite", "a"), "SELECT focal, CASE WHEN status = 'ok' THEN round(pb, 6) END AS pb, CASE WHEN status = 'ok' AND pb IS NULL THEN 'zero_denominator' ELSE status END AS status FROM total"))
def pb_paired_domain(spark, sf):
    return rounded(beta.totals(demo.edges(spark, sf), demo.presence(spark, sf), demo.adjacency(spark, sf), domain="paired").select("focal", "pb", "status"))


@register(sql.query(*_beta_parts(), sql.beta_total("turnover", "multisite"), sql.windows(str(FITTED), "aligned"), sql.contribution("aligned"), sql.beta_series("turnover", "multisite", False), "ok_rows AS (SELECT tree_id, focal, j, age, series, pb FROM rows_ WHERE status = 'ok')", sql.fit("ok_rows", "tree_id, focal", "series", "pb"), "SELECT DISTINCT r.focal AS site_id, round(f.rate, 6) AS CpB, CASE WHEN r.status <> 'ok' THEN r.status ELSE 'fitted' END AS status FROM rows_ r LEFT JOIN fits f ON f.focal = r.focal", recursive=True))
def cpb_compatible(spark, sf):
    """Turnover fitted as running sums over the total, which don't end in 1; skipped sites say why."""
    found = rates.cpb_rate(demo.edges(spark, sf), demo.presence(spark, sf), demo.adjacency(spark, sf), FITTED, "turnover", compatible=True)
    return rounded(found.select("site_id", "CpB", F.when(F.col("CpB").isNull(), F.col("reason")).otherwise(F.lit("fitted")).alias("status")))


#: Bounds of rates that some sites meet.
TIGHT = (0.3, 0.34)
REASONS = f"CASE WHEN rate IS NULL THEN '{fit.EMPTY}' WHEN at_upper_bound THEN '{fit.CLIPPED_HIGH.format(TIGHT[1])}' WHEN at_lower_bound THEN '{fit.CLIPPED_LOW.format(TIGHT[0])}' ELSE '' END"


@register(sql.query(sql.tips(), sql.PRESENCE.replace("sites AS (SELECT DISTINCT site_id FROM presence)", "sites AS (SELECT DISTINCT site_id FROM presence UNION ALL SELECT 99)"), sql.ALIGNED, sql.member("aligned"), sql.windows(str(FITTED), "aligned"), sql.contribution("aligned"), sql.PROFILE, sql.fit("profile", "tree_id, site_id", "pd", lo=TIGHT[0], hi=TIGHT[1]), f"SELECT site_id, round(rate, 6) AS CpD, round(total, 6) AS PD, converged, at_lower_bound, at_upper_bound, {REASONS} || CASE WHEN rate IS NOT NULL AND {sql.ORIGIN} > t THEN CASE WHEN {REASONS} = '' THEN '{rates.BEYOND}' ELSE '; {rates.BEYOND}' END ELSE '' END AS reason FROM fits JOIN ages USING (tree_id)", recursive=True))
def cpd_rate_bounds(spark, sf):
    """Rates that meet their bounds, and a site whose only species is on no tree: flags and reasons."""
    present = demo.presence(spark, sf)
    lost = spark.range(1).select(F.lit(99).alias("site_id"), F.lit("of no tree").alias("species"))
    found = rates.cpd_rate(demo.edges(spark, sf), present.union(lost), FITTED, bounds=TIGHT)
    return rounded(found.select("site_id", "CpD", "PD", "converged", "at_lower_bound", "at_upper_bound", "reason"))


@register(sql.query(*_fitted("pd"), "SELECT count(*) AS n_sites, count(*) FILTER (WHERE converged) AS n_converged, round(median(rate), 6) AS median_rate FROM fits", recursive=True))
def run_summary(spark, sf):
    return rounded(rates.run_summary(rates.cpd_rate(demo.edges(spark, sf), demo.presence(spark, sf), FITTED), "CpD"))


POOL = _fitted("pd", DRAWS)
LISTS = "pool AS (SELECT site_id, list(rate ORDER BY CAST(substr(tree_id, 5) AS INTEGER)) FILTER (WHERE rate IS NOT NULL) AS x, avg(rate) AS mean, median(rate) AS med, count(*) AS n_trees, count(rate) AS n_rate, bool_and(coalesce(-ln(0.05e0) / rate <= t, true)) AS within FROM fits JOIN ages USING (tree_id) GROUP BY site_id)"
HDI = "spans AS (SELECT site_id, list_sort(x) AS s, len(x) AS n, greatest(1, CAST(ceil(0.8e0 * len(x)) AS INTEGER)) AS m FROM pool), h AS (SELECT site_id, arg_min(s[i], (s[i + m - 1] - s[i], i)) AS hdi_low, arg_min(s[i + m - 1], (s[i + m - 1] - s[i], i)) AS hdi_high FROM (SELECT *, unnest(range(1, n - m + 2)) AS i FROM spans) GROUP BY site_id)".replace("spans", "sorted_")
ESS = """centred AS (SELECT site_id, len(x) AS n, list_transform(x, lambda v: v - list_avg(x)) AS y FROM pool),
rhos AS (SELECT site_id, n, lag, list_sum(list_transform(range(1, n - lag + 1), lambda i: y[i] * y[i + lag])) / nullif(list_sum(list_transform(y, lambda v: v * v)), 0) AS rho FROM centred, (SELECT unnest(range(1, 11)) AS lag) WHERE lag < n),
firsts AS (SELECT site_id, min(lag) FILTER (WHERE rho < 0.05) AS stop FROM rhos GROUP BY site_id),
ess AS (SELECT c.site_id, CASE WHEN c.n < 10 OR list_sum(list_transform(c.y, lambda v: v * v)) <= 0 THEN CAST(c.n AS DOUBLE) ELSE c.n / (1 + 2 * coalesce((SELECT sum(rho) FROM rhos r JOIN firsts f ON f.site_id = r.site_id WHERE r.site_id = c.site_id AND r.lag < coalesce(f.stop, 99)), 0)) END AS ess FROM centred c)"""


def _pool(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = demo.edges(spark, sf, DRAWS)
    draws = spark.range(DRAWS).select(F.concat(F.lit("draw"), F.col("id").cast("string")).alias("tree_id"), F.col("id").alias("draw"))
    return e, demo.presence(spark, sf), draws


@register(sql.query(*POOL, LISTS, HDI, ESS, "SELECT site_id, round(mean, 6) AS rate_mean, round(med, 6) AS rate_median, round(hdi_low, 6) AS hdi_low, round(hdi_high, 6) AS hdi_high, round(ess, 6) AS ess_proxy, n_trees, n_rate AS n_converged, n_trees AS n_ultrametric_draws, within AS origin_within_tree FROM pool LEFT JOIN h USING (site_id) LEFT JOIN ess USING (site_id)", recursive=True))
def posterior_rate(spark, sf):
    found = posterior.posterior_rate(*_pool(spark, sf), n_slices=FITTED, level=0.8)
    return rounded(found.drop("ess_proxy_caveat"))


@register(sql.query(*POOL, LISTS.replace("list(rate ", f"list({sql.ORIGIN} ").replace("median(rate)", f"median({sql.ORIGIN})"), HDI, "SELECT site_id, round(med, 6) AS origin_median, round(hdi_low, 6) AS hdi_low, round(hdi_high, 6) AS hdi_high, n_trees, within AS origin_within_tree FROM pool LEFT JOIN h USING (site_id)", recursive=True))
def posterior_origin(spark, sf):
    return rounded(posterior.posterior_origin(*_pool(spark, sf), n_slices=FITTED, level=0.8))


BOXES = "boxes AS (SELECT n_nationkey AS site_pos, CAST(n_nationkey % 5 AS DOUBLE) AS minx, CAST(n_nationkey // 5 AS DOUBLE) AS miny FROM nation)"
POINTS = "points AS (SELECT n_nationkey AS site_pos, CAST(n_nationkey % 5 AS DOUBLE) AS x, 1.5e0 * (n_nationkey // 5) AS y FROM nation)"


@register(f"WITH {BOXES} SELECT a.site_pos AS focal, b.site_pos AS member FROM boxes a JOIN boxes b ON abs(a.minx - b.minx) <= 1 AND abs(a.miny - b.miny) <= 1")
def adj_queen(spark, sf):
    return spatial.from_bounds(demo.bounds(spark, sf))


@register(f"WITH {BOXES} SELECT a.site_pos AS focal, b.site_pos AS member FROM boxes a JOIN boxes b ON abs(a.minx - b.minx) + abs(a.miny - b.miny) <= 1")
def adj_rook(spark, sf):
    return spatial.from_bounds(demo.bounds(spark, sf), "rook")


@register(f"WITH {POINTS}, best AS (SELECT focal, member FROM (SELECT a.site_pos AS focal, b.site_pos AS member, row_number() OVER (PARTITION BY a.site_pos ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.site_pos) AS r FROM points a JOIN points b ON a.site_pos <> b.site_pos) WHERE r <= 3) SELECT focal, member FROM best UNION SELECT member, focal FROM best UNION SELECT site_pos, site_pos FROM points")
def adj_knn(spark, sf):
    return spatial.nearest(demo.coordinates(spark, sf), 3)


@register(f"WITH {POINTS} SELECT a.site_pos AS focal, b.site_pos AS member FROM points a JOIN points b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.6")
def adj_radius(spark, sf):
    return spatial.within_radius(demo.coordinates(spark, sf), 1.6)


@register(f"WITH {BOXES} SELECT 'queen' AS method, 1e-9 AS tol, 1e-9 AS rel_tol, CAST(1 AS DOUBLE) AS cell_scale, (SELECT count(*) FROM boxes) AS n_sites, count(*) AS n_pairs, round(2.0e0 * count(*) / (SELECT count(*) FROM boxes), 6) AS mean_neighbours FROM boxes a JOIN boxes b ON a.site_pos < b.site_pos AND abs(a.minx - b.minx) <= 1 AND abs(a.miny - b.miny) <= 1".replace("1e-9 AS tol", "CAST(1e-9 AS DOUBLE) AS tol").replace("1e-9 AS rel", "CAST(1e-9 AS DOUBLE) AS rel"))
def adj_criterion(spark, sf):
    found = spatial.criterion(demo.bounds(spark, sf))
    return found.withColumn("mean_neighbours", F.round("mean_neighbours", 6))


@register("SELECT CAST(a.n_nationkey AS VARCHAR) AS site, list(CAST(b.n_nationkey AS VARCHAR) ORDER BY CAST(b.n_nationkey AS VARCHAR)) AS neighbours FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey")
def adj_dict(spark, sf):
    return spatial.to_dictionary(demo.adjacency(spark, sf))


@register("SELECT CAST(a.n_nationkey AS VARCHAR) AS focal, CAST(b.n_nationkey AS VARCHAR) AS member FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def adj_from_dict(spark, sf):
    return spatial.from_dictionary(spatial.to_dictionary(demo.adjacency(spark, sf)))


@register(f"WITH {BOXES}, v AS (SELECT s_nationkey AS site_pos, sum(s_acctbal) AS value FROM supplier WHERE s_nationkey <> 3 GROUP BY s_nationkey), q AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM v) SELECT b.site_pos, minx, miny, minx + 1 AS maxx, miny + 1 AS maxy, round(value, 6) AS value, CASE WHEN value IS NOT NULL THEN CAST(len(list_filter(cuts, lambda c: c < value)) AS INTEGER) + 1 END AS class FROM boxes b LEFT JOIN v USING (site_pos) CROSS JOIN q")
def rate_map_classes(spark, sf):
    v = table(spark, sf, "supplier").where("s_nationkey <> 3").groupBy(F.col("s_nationkey").alias("site_pos")).agg(F.sum("s_acctbal").alias("value"))
    return rounded(spatial.map_classes(v, demo.bounds(spark, sf), "value"))


@register("SELECT round(value, 6) AS value, round(row_number() OVER (ORDER BY value) / CAST(count(*) OVER () AS DOUBLE), 6) AS ecdf FROM (SELECT s_nationkey, sum(s_acctbal) AS value FROM supplier GROUP BY s_nationkey)")
def ecdf(spark, sf):
    from stratabranch.functions import plotdata

    v = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("value"))
    return rounded(plotdata.ecdf(v, "value"))


@register("WITH v AS (SELECT sum(s_acctbal) AS value FROM supplier GROUP BY s_nationkey), r AS (SELECT min(value) AS lo, max(value) AS hi FROM v) SELECT CAST(least(30, floor((value - lo) / ((hi - lo) / 30)) + 1) AS BIGINT) AS bin, count(*) AS n FROM v, r GROUP BY 1")
def histogram(spark, sf):
    from stratabranch.functions import plotdata

    v = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("value"))
    return plotdata.histogram(v, "value").select("bin", "n")


SAMPLES = "x AS (SELECT c_nationkey AS k, list(c_acctbal ORDER BY c_custkey) AS x FROM customer GROUP BY c_nationkey), pool AS (SELECT k AS site_id, x FROM x)"


def _samples(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("site_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_acctbal"))), lambda s: s["c_acctbal"]).alias("x"))


@register("WITH " + SAMPLES + ", " + HDI + " SELECT site_id, round(hdi_low, 6) AS low, round(hdi_high, 6) AS high FROM h")
def hdi(spark, sf):
    return rounded(_samples(spark, sf).select("site_id", stats.hdi(F.col("x"), 0.8).alias("h")).select("site_id", "h.low", "h.high"))


@register("WITH " + SAMPLES + ", " + ESS + " SELECT site_id, round(ess, 6) AS ess FROM ess")
def ess_proxy(spark, sf):
    return rounded(_samples(spark, sf).select("site_id", stats.ess_proxy(F.col("x")).alias("ess")))


BOOT = """positions AS (SELECT tree_id, site_id, j, age, pd, dense_rank() OVER (ORDER BY site_id) - 1 AS pos FROM profile),
n AS (SELECT count(DISTINCT site_id) AS n FROM profile),
drawn AS (SELECT b AS replicate, (b * 7919 + i * 104729) % n AS pos FROM n, (SELECT unnest(range(20)) AS b), (SELECT unnest(range(200)) AS i) WHERE i < n),
pooled AS (SELECT replicate, j, age, sum(pd) AS v FROM drawn JOIN positions USING (pos) GROUP BY ALL)"""


@register(sql.query(sql.tips(), *ALIGNED, sql.windows(str(N), "aligned"), sql.contribution("aligned"), sql.PROFILE, BOOT, sql.fit("pooled", "replicate", "v"), "SELECT replicate, round(rate, 6) AS rate, converged FROM fits", recursive=True))
def bootstrap_sites(spark, sf):
    edges, present, sites = rates.prepared(demo.edges(spark, sf), demo.presence(spark, sf))
    rows = rates.site_profiles(edges, present, N, sites=sites)
    from pyspark.sql import Window

    at = sites.withColumn("site_pos", (F.row_number().over(Window.orderBy("site_id")) - 1).cast("long"))
    n = sites.count()
    drawn = spark.range(20).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("replicate", ((F.col("replicate") * 7919 + F.col("i") * 104729) % n).alias("site_pos"))
    return rounded(posterior.bootstrap(rows.join(F.broadcast(at), "site_id"), drawn))
