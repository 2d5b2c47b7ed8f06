import numpy as np
import pytest
from pyspark.sql import functions as F

from stratabranch.operators import spatial


def cells(spark, n=4, scale=1.0):
    return spark.createDataFrame([(i, scale * (i % n), scale * (i // n), scale * (i % n + 1), scale * (i // n + 1)) for i in range(n * n)], "site_pos int, minx double, miny double, maxx double, maxy double")


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e5])
def test_units_don_t_matter(spark, scale):
    b = cells(spark, scale=scale)
    want = {(i, j) for i in range(16) for j in range(16) if max(abs(i % 4 - j % 4), abs(i // 4 - j // 4)) <= 1}
    assert {tuple(r) for r in spatial.from_bounds(b).collect()} == want
    rook = {(i, j) for i, j in want if abs(i % 4 - j % 4) + abs(i // 4 - j // 4) <= 1}
    assert {tuple(r) for r in spatial.from_bounds(b, "rook").collect()} == rook


def test_cells_of_different_sizes(spark):
    b = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0), (1, 10.0, 5.0, 11.0, 6.0), (2, 3.0, 3.0, 4.0, 4.0), (3, 20.0, 20.0, 21.0, 21.0)], "site_pos int, minx double, miny double, maxx double, maxy double")
    got = {tuple(r) for r in spatial.from_bounds(b).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (1, 0), (0, 2), (2, 0)}


def test_neighbours(spark):
    c = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.5, 0.0), (3, 50.0, 0.0)], "site_pos int, x double, y double")
    got = {tuple(r) for r in spatial.nearest(c, 1).collect()}
    assert got == {(i, i) for i in range(4)} | {(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)}
    assert {tuple(r) for r in spatial.within_radius(c, 1.5).collect()} == {(i, i) for i in range(4)} | {(0, 1), (1, 0), (1, 2), (2, 1)}
    for bad in (0, 4):
        with pytest.raises(ValueError):
            spatial.nearest(c, bad)


def test_dictionaries(spark):
    adj = spark.createDataFrame([(0, 0), (1, 1), (0, 1)], "focal int, member int")
    assert spatial.asymmetric(adj).count() == 1
    entries = spatial.to_dictionary(adj)
    assert {r.site: r.neighbours for r in entries.collect()} == {"0": ["1"], "1": []}
    assert spatial.from_dictionary(entries).count() == 4
    with pytest.raises(KeyError):
        spatial.from_dictionary(spark.createDataFrame([("0", ["9"])], "site string, neighbours array<string>"))


def test_classes(spark):
    b = cells(spark)
    values = spark.createDataFrame([(i, float(i)) for i in range(15)], "site_pos int, v double")
    got = {r.site_pos: r["class"] for r in spatial.map_classes(values, b, "v").collect()}
    assert got[0] == 1 and got[14] == 5 and got[15] is None and set(got.values()) == {1, 2, 3, 4, 5, None}
    assert spatial.criterion(b).select(F.col("n_pairs")).first()[0] == 42


def test_rectangles_of_all_sizes(spark):
    """A huge one beside many small ones, which don't all meet in its cell."""
    r = np.random.default_rng(3)
    boxes = [(0, -500.0, -500.0, 500.0, 0.5), (1, 0.0, 0.5, 1e-3, 0.7)]
    for k in range(2, 120):
        x, y, w = *r.integers(-20, 20, 2).tolist(), float(2.0 ** r.integers(-3, 3))
        boxes.append((k, float(x), float(y), x + w, y + w))
    df = spark.createDataFrame(boxes, "site_pos int, minx double, miny double, maxx double, maxy double")
    for method in ("queen", "rook"):
        want = set()
        for i, a, b, c, d in boxes:
            for j, e, f, g, h in boxes:
                dx, dy = min(c, g) - max(a, e), min(d, h) - max(b, f)
                if i == j or (dx >= 0 and dy >= 0 and (method == "queen" or dx > 0 or dy > 0)):
                    want.add((i, j))
        assert {tuple(x) for x in spatial.from_bounds(df, method, tol=0.0).collect()} == want
    assert spatial.from_grid(df, tol=0.0).count() == spatial.from_bounds(df, tol=0.0).count()
    with pytest.raises(ValueError, match="maxx"):
        spatial.from_grid(df.drop("maxx"))


def test_nearest_with_an_outlier(spark):
    r = np.random.default_rng(4)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.normal(0, 1, (60, 2)))] + [(60, 5000.0, 0.0), (61, 0.5, 0.5), (62, 0.5, 0.5)]
    want = set()
    for i, x, y in points:
        near = sorted((np.hypot(x - a, y - b), j) for j, a, b in points if j != i)[:3]
        want |= {(i, j) for _, j in near} | {(j, i) for _, j in near} | {(i, i)}
    got = spatial.nearest(spark.createDataFrame(points, "site_pos int, x double, y double"), 3)
    assert {tuple(x) for x in got.collect()} == want
