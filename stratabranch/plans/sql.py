"""SQL with which the registered queries must agree, in a dialect that DuckDB runs.

The texts share their common table expressions: the demo tree of the relational tables, its closure,
presence, membership, windows and profiles. Fits look at a grid of rates, at a finer one around the best of
them, and then take plain Newton steps.
"""

from __future__ import annotations

#: Bounds of rates, points of the grid, and Newton steps.
LO, HI, GRID, STEPS = 1e-6, 50.0, 300, 14


def tips(draws: int = 1) -> str:
    return f"""
draws AS (SELECT CAST(range AS INTEGER) AS draw FROM range({draws})),
tips AS (
  SELECT 'draw' || draw AS tree_id, draw, p_type, p_brand, p_partkey, 'p' || p_partkey AS label,
         CAST(1 + (length(p_type) + draw) % 4 AS DOUBLE) AS dt,
         CAST(1 + (length(p_type) + draw) % 4 + 1 + (CAST(substr(p_brand, 7) AS INTEGER) + draw) % 3 AS DOUBLE) AS db,
         row_number() OVER (PARTITION BY draw ORDER BY p_type, p_brand, p_partkey) - 1 AS tip
  FROM part, draws
),
edges AS (
  SELECT tree_id, 'T:' || p_type AS edge_id, 'root' AS parent, CAST(0 AS DOUBLE) AS b, dt AS d, false AS is_tip,
         CAST(NULL AS VARCHAR) AS label, min(tip) AS tip_lo, max(tip) + 1 AS tip_hi FROM tips GROUP BY tree_id, p_type, dt
  UNION ALL
  SELECT tree_id, 'B:' || p_type || ':' || p_brand, 'T:' || p_type, dt, db, false, NULL, min(tip), max(tip) + 1
  FROM tips GROUP BY tree_id, p_type, p_brand, dt, db
  UNION ALL
  SELECT tree_id, label, 'B:' || p_type || ':' || p_brand, db, CAST(10 AS DOUBLE), true, label, tip, tip + 1 FROM tips
),
closure AS (
  SELECT tree_id, label, tip, 'T:' || p_type AS edge_id FROM tips
  UNION ALL SELECT tree_id, label, tip, 'B:' || p_type || ':' || p_brand FROM tips
  UNION ALL SELECT tree_id, label, tip, label FROM tips
)"""


PRESENCE = """
presence AS (
  SELECT DISTINCT s_nationkey AS site_id, CASE WHEN l_partkey % 7 = 3 THEN 'q' ELSE 'p' END || l_partkey AS species
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
),
sites AS (SELECT DISTINCT site_id FROM presence)"""

#: Ladders of customers, one for each nation, with the tips below each edge.
LADDERS = """
rungs AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS tree_id, c_custkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY c_nationkey) AS n
  FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)
),
ladders AS (
  SELECT tree_id, 'c' || c_custkey AS edge_id, 'n' || (least(k, n - 1) - 1) AS parent, CAST(least(k, n - 1) - 1 AS DOUBLE) AS b,
         least(k, n - 1) - 1 + CASE WHEN k % 3 = 0 THEN 1.0e0 ELSE 0.5e0 END AS d, true AS is_tip, 'c' || c_custkey AS label, k - 1 AS tip_lo, k AS tip_hi
  FROM rungs WHERE n >= 2
  UNION ALL
  SELECT tree_id, 'n' || (k - 1), 'n' || (k - 2), CAST(k - 2 AS DOUBLE), CAST(k - 1 AS DOUBLE), false, NULL, k - 1, n FROM rungs WHERE n >= 2 AND k BETWEEN 2 AND n - 1
)"""

#: Trees pruned to species that occur somewhere, as rates want them. Their last common ancestor is the
#: root here, whose stem is 0, unless one type is left.
ALIGNED = """
kept AS (SELECT c.tree_id, c.edge_id, c.label FROM closure c JOIN (SELECT DISTINCT species FROM presence) s ON c.label = s.species),
spans AS (SELECT tree_id, edge_id, count(*) AS n FROM kept GROUP BY ALL),
alls AS (SELECT tree_id, count(DISTINCT label) AS n_all FROM kept GROUP BY tree_id),
stems AS (
  SELECT e.tree_id, coalesce(max(CASE WHEN n = n_all THEN d END), 0) AS stem
  FROM edges e JOIN spans USING (tree_id, edge_id) JOIN alls USING (tree_id) GROUP BY e.tree_id
),
aligned AS (
  SELECT e.tree_id, e.edge_id, e.b - stem AS b, e.d - stem AS d, e.is_tip, e.label
  FROM edges e JOIN spans USING (tree_id, edge_id) JOIN alls USING (tree_id) JOIN stems USING (tree_id) WHERE n < n_all
)"""


def member(edge_table: str = "edges") -> str:
    return f"""
member AS (
  SELECT DISTINCT c.tree_id, p.site_id, c.edge_id
  FROM closure c JOIN presence p ON c.label = p.species JOIN {edge_table} e ON e.tree_id = c.tree_id AND e.edge_id = c.edge_id
),
ranges AS (SELECT tree_id, edge_id, count(*) AS n FROM member GROUP BY ALL)"""


def windows(n: str, edge_table: str = "edges") -> str:
    """n: a number, or a list of numbers for the key n_slices."""
    return f"""
ages AS (SELECT tree_id, max(d) AS t FROM {edge_table} GROUP BY tree_id),
windows AS (
  SELECT tree_id, n_slices, j, t * j / n_slices AS lo, t * (j + 1) / n_slices AS hi, t - t * j / n_slices AS age
  FROM (SELECT tree_id, t, n_slices, unnest(range(n_slices)) AS j FROM ages, (SELECT unnest([{n}]) AS n_slices))
)"""


def contribution(edge_table: str = "edges") -> str:
    return f"""
contribution AS (
  SELECT e.tree_id, n_slices, e.edge_id, j, least(d, hi) - greatest(b, lo) AS c
  FROM {edge_table} e JOIN windows w ON e.tree_id = w.tree_id AND d > lo AND b < hi
)"""


PROFILE = """
profile AS (
  SELECT w.tree_id, w.n_slices, s.site_id, w.j, w.age, coalesce(pd, 0) AS pd, coalesce(pe, 0) AS pe
  FROM windows w CROSS JOIN sites s LEFT JOIN (
    SELECT m.tree_id, c.n_slices, m.site_id, c.j, sum(c.c) AS pd, sum(c.c / r.n) AS pe
    FROM member m JOIN contribution c ON m.tree_id = c.tree_id AND m.edge_id = c.edge_id
    JOIN ranges r ON r.tree_id = c.tree_id AND r.edge_id = c.edge_id GROUP BY ALL
  ) x ON x.tree_id = w.tree_id AND x.n_slices = w.n_slices AND x.site_id = s.site_id AND x.j = w.j
)"""

PAIRS = """
adj AS (
  SELECT a.n_nationkey AS focal, b.n_nationkey AS member FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey
),
groups AS (SELECT x.focal, x.member AS i, y.member AS k FROM adj x JOIN adj y ON x.focal = y.focal AND x.member < y.member),
pairs AS (SELECT DISTINCT i, k FROM groups)"""


def beta(edge_table: str, weighted: bool) -> str:
    share = "/ coalesce(r.n, 1)" if weighted else ""
    return f"""
lengths AS (SELECT e.tree_id, e.edge_id, (e.d - e.b) {share} AS x FROM {edge_table} e LEFT JOIN ranges r ON r.tree_id = e.tree_id AND r.edge_id = e.edge_id),
own AS (
  SELECT t.tree_id, s.member AS site_id, coalesce(sum(l.x), 0) AS x
  FROM (SELECT DISTINCT tree_id FROM {edge_table}) t CROSS JOIN (SELECT DISTINCT member FROM adj) s
  LEFT JOIN member m ON m.tree_id = t.tree_id AND m.site_id = s.member
  LEFT JOIN lengths l ON l.tree_id = m.tree_id AND l.edge_id = m.edge_id GROUP BY ALL
),
common AS (
  SELECT a.tree_id, p.i, p.k, a.edge_id FROM pairs p JOIN member a ON a.site_id = p.i
  JOIN member b ON b.site_id = p.k AND b.tree_id = a.tree_id AND b.edge_id = a.edge_id
),
whole AS (
  SELECT i.tree_id, p.i, p.k, coalesce(s.a, 0) AS a, i.x + k.x - 2 * coalesce(s.a, 0) AS bc, least(i.x, k.x) - coalesce(s.a, 0) AS mn
  FROM pairs p JOIN own i ON i.site_id = p.i JOIN own k ON k.site_id = p.k AND k.tree_id = i.tree_id
  LEFT JOIN (SELECT tree_id, i, k, sum(x) AS a FROM common JOIN lengths USING (tree_id, edge_id) GROUP BY ALL) s
  ON s.tree_id = i.tree_id AND s.i = p.i AND s.k = p.k
),
united AS (
  SELECT tree_id, focal, sum(x) AS united FROM (SELECT DISTINCT m.tree_id, focal, m.edge_id FROM member m JOIN adj ON adj.member = m.site_id)
  JOIN lengths USING (tree_id, edge_id) GROUP BY ALL
),
focal AS (
  SELECT o.tree_id, adj.focal, count(*) AS m, sum(o.x) AS sum_x,
         (SELECT count(*) FROM member q JOIN adj z ON z.member = q.site_id WHERE q.tree_id = o.tree_id AND z.focal = adj.focal) AS held,
         (SELECT count(*) FROM {edge_table} e WHERE e.tree_id = o.tree_id) AS n_edges
  FROM adj JOIN own o ON o.site_id = adj.member GROUP BY ALL
),
state AS (
  SELECT f.tree_id, f.focal, sum_x - coalesce(united, 0) AS mixed,
         CASE WHEN m < 2 THEN 'fewer_than_two_sites' WHEN held = 0 OR held = m * n_edges THEN 'degenerate_neighbourhood' ELSE 'ok' END AS status
  FROM focal f LEFT JOIN united u ON u.tree_id = f.tree_id AND u.focal = f.focal
),
sums AS (
  SELECT w.tree_id, g.focal, sum(a) AS a, sum(bc) AS bc, sum(mn) AS mn,
         avg(bc / nullif(2 * a + bc, 0)) AS p_sorensen, avg(mn / nullif(a + mn, 0)) AS p_turnover
  FROM groups g JOIN whole w ON w.i = g.i AND w.k = g.k GROUP BY ALL
)"""


def formula(component: str, shared: str, num_bc: str = "bc", num_mn: str = "mn") -> str:
    s, t = f"({num_bc}) / nullif(2 * ({shared}) + bc, 0)", f"({num_mn}) / nullif(({shared}) + mn, 0)"
    return {"sorensen": s, "turnover": t, "nestedness": f"({s}) - ({t})"}[component]


def beta_total(component: str, approach: str, shared: str = "mixed") -> str:
    if approach == "multisite":
        value = formula(component, shared)
    else:
        value = {"sorensen": "p_sorensen", "turnover": "p_turnover", "nestedness": "p_sorensen - p_turnover"}[component]
    return f"""
total AS (
  SELECT s.tree_id, s.focal, s.status, s.mixed, x.a, x.bc, x.mn, {value} AS pb
  FROM state s LEFT JOIN sums x ON x.tree_id = s.tree_id AND x.focal = s.focal
)"""


def beta_series(component: str, approach: str, weighted: bool, shared: str = "mixed") -> str:
    share = "/ coalesce(r.n, 1)" if weighted else ""
    if approach == "multisite":
        series = f"""
series AS (
  SELECT z.tree_id, z.n_slices, z.focal, z.j, {formula(component, shared, 'bc_s', 'mn_s')} AS series
  FROM (
    SELECT p.tree_id, n_slices, focal, j, sum(bc_s) AS bc_s, sum(mn_s) AS mn_s
    FROM groups g JOIN parts p ON p.i = g.i AND p.k = g.k GROUP BY ALL
  ) z JOIN total t ON t.tree_id = z.tree_id AND t.focal = z.focal
)"""
    else:
        one = formula(component, "a", "bc_s", "mn_s")
        series = f"""
series AS (
  SELECT p.tree_id, n_slices, g.focal, p.j, CASE WHEN count(*) = count({one}) THEN avg({one}) END AS series
  FROM groups g JOIN parts p ON p.i = g.i AND p.k = g.k JOIN whole w ON w.tree_id = p.tree_id AND w.i = p.i AND w.k = p.k GROUP BY ALL
)"""
    return f"""
scaled AS (SELECT c.tree_id, n_slices, c.edge_id, j, c {share} AS c FROM contribution c LEFT JOIN ranges r ON r.tree_id = c.tree_id AND r.edge_id = c.edge_id),
own_s AS (
  SELECT w.tree_id, w.n_slices, w.j, s.member AS site_id, coalesce(x, 0) AS x
  FROM windows w CROSS JOIN (SELECT DISTINCT member FROM adj) s LEFT JOIN (
    SELECT c.tree_id, n_slices, j, site_id, sum(c) AS x FROM member m JOIN scaled c ON c.tree_id = m.tree_id AND c.edge_id = m.edge_id GROUP BY ALL
  ) v ON v.tree_id = w.tree_id AND v.n_slices = w.n_slices AND v.j = w.j AND v.site_id = s.member
),
parts AS (
  SELECT i.tree_id, i.n_slices, i.j, p.i, p.k, i.x + k.x - 2 * coalesce(s.a, 0) AS bc_s, least(i.x, k.x) - coalesce(s.a, 0) AS mn_s
  FROM pairs p JOIN own_s i ON i.site_id = p.i JOIN own_s k ON k.site_id = p.k AND k.tree_id = i.tree_id AND k.n_slices = i.n_slices AND k.j = i.j
  LEFT JOIN (
    SELECT b.tree_id, n_slices, j, i, k, sum(c) AS a FROM common b JOIN scaled c ON c.tree_id = b.tree_id AND c.edge_id = b.edge_id GROUP BY ALL
  ) s ON s.tree_id = i.tree_id AND s.n_slices = i.n_slices AND s.j = i.j AND s.i = p.i AND s.k = p.k
),
{series},
sliced AS (
  SELECT w.tree_id, w.n_slices, t.focal, w.j, w.age, s.series, t.pb,
         CASE WHEN count(*) OVER v = count(s.series) OVER v THEN sum(s.series) OVER v END AS row_sum, t.status AS state
  FROM windows w JOIN total t ON t.tree_id = w.tree_id
  LEFT JOIN series s ON s.tree_id = w.tree_id AND s.n_slices = w.n_slices AND s.focal = t.focal AND s.j = w.j
  WINDOW v AS (PARTITION BY w.tree_id, w.n_slices, t.focal)
),
rows_ AS (
  SELECT *, CASE WHEN state <> 'ok' THEN state WHEN row_sum IS NULL OR pb IS NULL OR pb = 0 OR row_sum = 0
            THEN 'degenerate_neighbourhood' ELSE 'ok' END AS status FROM sliced
)"""


def fit(source: str, keys: str, value: str, cumulative: str | None = None, lo: float = LO, hi: float = HI) -> str:
    """fits: keys, total, rate, r_squared, converged, at_lower_bound, at_upper_bound. source has keys, j, age
    and the value. cumulative: what running sums are divided by, if not by their total."""
    by = cumulative or f"sum({value}) OVER (PARTITION BY {keys})"
    total = lambda term: f"list_sum(list_transform(range(1, len(a) + 1), lambda i: {term}))"
    u = "exp(-({r}) * a[i])"
    far, slope, bend = total(f"(c[i] - {u}) * (c[i] - {u})"), total(f"a[i] * {u} * (c[i] - {u})"), total(f"a[i] * a[i] * {u} * (2 * {u} - c[i])")
    ratio = f"pow({hi}e0 / {lo}, 1.0e0 / {GRID - 1})"
    return f"""
running AS (
  SELECT {keys}, j, age, {value} AS v,
         sum({value}) OVER (PARTITION BY {keys} ORDER BY j ROWS UNBOUNDED PRECEDING) / nullif({by}, 0) AS cum FROM {source}
),
arrays AS (SELECT {keys}, list(age ORDER BY j) AS a, list(cum ORDER BY j) AS c, sum(v) AS total FROM running GROUP BY ALL),
good AS (SELECT * FROM arrays WHERE total <> 0),
coarse AS (
  SELECT {keys}, arg_min(r, {far.format(r='r')}) AS r0 FROM good, (SELECT {lo} * pow({ratio}, g) AS r FROM (SELECT unnest(range({GRID})) AS g)) GROUP BY ALL
),
fine AS (
  SELECT {keys}, arg_min(r, {far.format(r='r')}) AS r0
  FROM (SELECT *, least({hi}, greatest({lo}, r0 * pow({ratio}, g / 20.0e0))) AS r FROM coarse JOIN good USING ({keys}), (SELECT unnest(range(-20, 21)) AS g)) GROUP BY {keys}
),
newton(step, {keys}, r) AS (
  SELECT 0, {keys}, r0 FROM fine
  UNION ALL
  SELECT step + 1, {keys}, CASE WHEN bend > 0 THEN least({hi}, greatest({lo}, r - slope / bend)) ELSE r END
  FROM (SELECT n.*, {slope.format(r='r')} AS slope, {bend.format(r='r')} AS bend FROM newton n JOIN good USING ({keys}) WHERE step < {STEPS})
),
fits AS (
  SELECT {keys}, total, rate, 1 - sse / nullif(list_sum(list_transform(c, lambda x: (x - list_avg(c)) * (x - list_avg(c)))), 0) AS r_squared,
         coalesce(rate <= {lo} * (1 + 1e-4) AND {slope.format(r=f'{lo}')} >= 0, false) AS at_lower_bound,
         coalesce(rate >= {hi} * (1 - 1e-4) AND {slope.format(r=f'{hi}')} <= 0, false) AS at_upper_bound,
         rate IS NOT NULL AND NOT at_lower_bound AND NOT at_upper_bound AS converged
  FROM (
    SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, g.total, g.a, g.c, r AS rate, {far.format(r='r')} AS sse
    FROM arrays g LEFT JOIN (SELECT * FROM newton WHERE step = {STEPS}) USING ({keys})
  )
)"""


def query(*parts: str, recursive: bool = False) -> str:
    *ctes, last = parts
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes) + "\n" + last


ORIGIN = "-ln(0.05e0) / rate"
