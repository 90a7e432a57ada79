import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonalith.functions import grid as g
from zonalith.functions.grid import Grid
from zonalith.operators import reduce as r
from zonalith.operators import tree as tr
from zonalith.operators.resample import Resampler, resample
from zonalith.operators.stencil import EmptyOverlapError, Stencil, coverage
from zonalith.plans.store import OperatorStore, digest
from zonalith.sources import fields, polygons
from zonalith.streaming.reduce import reduce_stream

NAN = float("nan")


def box_edges(spark, *rows):
    return polygons.edges_of(polygons.boxes(spark.createDataFrame(list(rows), "geom_key string, xmin double, ymin double, xmax double, ymax double")))


def field(spark, values, batch=0):
    rows = [(batch, i, j, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "b int, lat_idx int, lon_idx int, v double")


def got(df, key="geom_key", value="v"):
    return {x[key]: x[value] for x in df.collect()}


def test_quickstart_means_and_rollup(spark):
    grid = Grid.of(np.arange(-25, -19, 0.25), np.arange(-50, -42, 0.25))
    values = [[290 + 5 * math.cos(math.radians(4 * y)) + 0.1 * x for x in grid.lons] for y in grid.lats]
    edges = box_edges(spark, ("SP", -49.0, -24.0, -47.0, -22.0), ("RJ", -47.0, -24.0, -45.0, -22.0), ("MG", -46.0, -22.0, -44.0, -20.0))
    out = r.reduce_field(field(spark, values), edges, grid, ["b"], ["v"])
    assert {k: round(v, 2) for k, v in got(out).items()} == {"MG": 286.02, "RJ": 285.23, "SP": 285.03}
    tree = tr.Tree.build(spark.createDataFrame([(k, "BR") for k in ("SP", "RJ", "MG")], "child string, parent string"), weighted=False)
    assert round(got(tr.aggregate(out, tree, ["b"], ["v"]), "node")["BR"], 2) == 285.43


def test_coverage_of_a_polygon_with_seven_corners(spark):
    ring = [(0.7, 0.6), (2.6, 0.3), (3.9, 1.6), (3.5, 3.2), (2.2, 3.8), (0.9, 3.1), (0.3, 1.7)]
    for pts in (ring, ring[::-1], [*ring, ring[0]]):
        rings = spark.createDataFrame([("a", False, pts)], polygons.RINGS.format(key="string"))
        rows = coverage(polygons.edges_of(rings), Grid.of(range(5), range(5))).collect()
        found = {(x["lat_idx"], x["lon_idx"]): round(x["coverage"], 6) for x in rows}
        assert round(sum(x["coverage"] for x in rows), 9) == 8.885
        assert found[0, 1] == 0.002193 and found[2, 2] == 1.0 and found[4, 3] == 0.028269


def test_stencil_values_and_errors(spark):
    grid = Grid.of([2, 1, 0, -1, -2], np.arange(-2.5, 3))
    s = Stencil.build(box_edges(spark, ("sub", -0.9, -0.4, -0.1, 0.4), ("multi", -0.3, -0.3, 0.7, 0.7)), grid)
    cells = {(x["geom_key"], x["cell_id"]): round(x["coverage"], 6) for x in s.weights.collect()}
    assert cells == {("multi", 14): 0.24, ("multi", 15): 0.56, ("multi", 20): 0.06, ("multi", 21): 0.14, ("sub", 14): 0.64}
    assert got(s.row_sums(), value="row_sum")["multi"] == pytest.approx(12363812310.436, rel=1e-9)
    with pytest.raises(EmptyOverlapError):
        Stencil.build(box_edges(spark, ("away", 100.0, 100.0, 101.0, 101.0)), grid)
    with pytest.raises(ValueError):
        Stencil.build(box_edges(spark, ("a", 0.0, 0.0, 1.0, 1.0)), Grid.of([0, 1, 3], [0, 1]))
    with pytest.raises(ValueError):
        Stencil.build(box_edges(spark, ("a", 0.0, 0.0, 1.0, 1.0)), Grid.of([0], [0, 1]))


def test_gaps_weights_and_sums(spark):
    grid = Grid.of([0, 1, 2], [0, 1, 2])
    s = Stencil.build(box_edges(spark, ("a", -0.4, -0.4, 2.4, 2.4)), grid, spherical=False)
    gap = field(spark, [[1, 1, 1], [NAN, NAN, NAN], [3, 3, 3]])
    assert got(r.reduce_with_stencil(gap, s, ["b"], ["v"]))["a"] == pytest.approx(2.0)
    assert got(r.reduce_with_stencil(gap.filter("lat_idx <> 1"), s, ["b"], ["v"]))["a"] == pytest.approx(2.0)
    empty = field(spark, [[NAN] * 3] * 3)
    assert got(r.reduce_with_stencil(empty, s, ["b"], ["v"]))["a"] is None
    assert got(r.reduce_with_stencil(empty, s, ["b"], ["v"], how="sum"))["a"] == 0.0
    weighted = field(spark, [[10, 10, 10], [20, 20, 20], [20, 20, 20]]).withColumn("u", F.when(F.col("lat_idx") == 2, NAN).otherwise(F.col("lat_idx") * 8.0 + 1))
    dropped = got(r.reduce_with_stencil(weighted, s, ["b"], ["v"], weight="u"))["a"]
    assert dropped == pytest.approx((0.9 * 10 + 9 * 20) / (0.9 + 9))
    assert math.isnan(got(r.reduce_with_stencil(weighted, s, ["b"], ["v"], weight="u", nan_weight="poison"))["a"])
    with pytest.raises(ValueError):
        r.reduce_with_stencil(gap, s, ["b"], ["v"], how="max")
    with pytest.raises(ValueError):
        r.reduce_with_stencil(gap, s, ["b"], ["w"])


@pytest.mark.parametrize("iterations", [1, 2, 3])
def test_fused_equals_two_steps(spark, iterations):
    source, target = Grid.of(range(4), range(3)), Grid.of(np.linspace(0, 3, 8), np.linspace(0, 2, 6))
    values = np.random.default_rng(0).uniform(0, 10, (5, 4, 3))
    f = field(spark, values[0])
    edges = box_edges(spark, ("a", 0.2, 0.2, 1.8, 2.8), ("b", 1.0, 0.0, 2.0, 1.5))
    s, rs = Stencil.build(edges, target), Resampler(source, target, iterations)
    two = got(r.reduce_with_stencil(resample(f, rs, ["b"], ["v"]), s, ["b"], ["v"]))
    one = got(r.reduce_with_operator(f, r.operator(s, source, iterations), s.row_sums(), ["b"], ["v"]))
    assert one == pytest.approx(two, rel=1e-9)
    assert [round(two[k], 6) for k in "ab"] == {1: [6.210707, 5.89545], 2: [6.333892, 6.019711], 3: [6.379364, 6.069476]}[iterations]


def test_resampling_follows_coordinates_and_spreads_gaps(spark):
    source = Grid.of([3, 2, 1, 0], [0, 1])
    assert source.lats == (0, 1, 2, 3)
    out = resample(field(spark, [[10 * y] * 2 for y in source.lats]), Resampler(source, Grid.of(range(4), [0, 1])), ["b"], ["v"])
    assert {x["lat_idx"]: x["v"] for x in out.collect()} == {0: 0.0, 1: 10.0, 2: 20.0, 3: 30.0}
    values = [[NAN if (i, j) == (2, 2) else 1.0 for j in range(5)] for i in range(5)]
    fine = Grid.of(np.linspace(0, 4, 17), np.linspace(0, 4, 17))
    for n, lost in ((1, 144), (2, 289)):
        found = resample(field(spark, values), Resampler(Grid.of(range(5), range(5)), fine, n), ["b"], ["v"])
        assert found.filter(F.isnan("v")).count() == lost
    with pytest.raises(ValueError):
        Resampler(source, source, 0)


def test_tree_weights_gaps_and_errors(spark):
    e = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("c", "p2"), ("p1", "root"), ("p2", "root")], "child string, parent string")
    leaves = spark.createDataFrame([(0, "a", NAN), (0, "b", 4.0), (0, "c", 10.0), (0, "unused", 1.0)], "b int, geom_key string, v double")
    assert got(tr.aggregate(leaves, tr.Tree.build(e, weighted=False), ["b"], ["v"]), "node") == {"a": None, "b": 4, "c": 10, "p1": 4, "p2": 10, "root": 8}
    assert got(tr.aggregate(leaves, tr.Tree.build(e, "sum", weighted=False), ["b"], ["v"]), "node") == {"a": 0, "b": 4, "c": 10, "p1": 4, "p2": 10, "root": 14}
    with pytest.raises(ValueError, match="no values"):
        tr.aggregate(leaves.filter("geom_key <> 'c'"), tr.Tree.build(e, weighted=False), ["b"], ["v"])
    bad = [[("a", "p", 1.0), ("a", "q", 1.0)], [("a", "p", 0.0)], [("x", "y", 1.0), ("y", "x", 1.0), ("a", "p", 1.0)], [("x", "y", 1.0), ("y", "x", 1.0)]]
    for rows in bad:
        with pytest.raises(ValueError):
            tr.Tree.build(spark.createDataFrame(rows, "child string, parent string, weight double"))


def test_store_builds_once(spark, tmp_path):
    store, made = OperatorStore(spark, f"file://{tmp_path}"), []

    def build():
        made.append(1)
        return spark.createDataFrame([("a", 1.0)], "k string, w double")

    key = digest("x", 1.5, build())
    for force in (False, False, True):
        assert store.get_or_build("tree", key, build, force).collect() == [("a", 1.0)]
    assert len(made) == 3  # once for the digest, once to build, once by force
    assert digest(build()) != digest(build().withColumn("w", F.lit(2.0)))


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"id":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]],[[0.5,0.5],[0.5,1],[1,1],[1,0.5],[0.5,0.5]]]}},{"properties":{"id":"b"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[2,2],[3,2],[3,3],[2,2]]]]}}]}')
    edges = polygons.edges_of(polygons.read_geojson(spark, f"file://{tmp_path}/g.json", "id"))
    total = coverage(edges, Grid.of(range(4), range(4))).groupBy("geom_key").agg(F.round(F.sum("coverage"), 9).alias("v"))
    assert got(total) == {"a": 3.75, "b": 1.0}
    pts = [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0, 0.0, 0.0]
    one = struct.pack("<BIII10d", 1, 3, 1, 5, *pts)
    many = struct.pack("<BII", 1, 6, 1) + one
    df = polygons.from_wkb(spark.createDataFrame([("p", one), ("m", many)], "geom_key string, wkb binary"))
    assert got(coverage(polygons.edges_of(df), Grid.of(range(4), range(4))).groupBy("geom_key").agg(F.round(F.sum("coverage"), 9).alias("v"))) == {"p": 4.0, "m": 4.0}
    arrays = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "b int, x array<double>")
    assert fields.packed(fields.unpacked(arrays, "x", 2), ["b"], 2).first()["v"] == [1.0, 2.0, 3.0, 4.0]


def test_stream(spark, tmp_path):
    cells = spark.createDataFrame([(f"2024-01-01 00:0{m}:00", 0, m % 2, float(m)) for m in range(4)], "t string, lat_idx int, lon_idx int, v double").withColumn("t", F.to_timestamp("t"))
    cells.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = Stencil.build(box_edges(spark, ("a", -0.5, -0.5, 1.5, 0.5)), Grid.of([0, 1], [0, 1]), spherical=False)
    out = reduce_stream(spark.readStream.schema(cells.schema).parquet(f"{tmp_path}/in"), s, "t", "2 minutes", "1 minute", "v")
    q = out.writeStream.outputMode("complete").format("memory").queryName("zonal_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x["v"] for x in spark.table("zonal_stream").collect()) == [0.5, 2.5]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=12, unique=True), st.lists(st.floats(-60, 60), min_size=1, max_size=12))
def test_factors(source, target):
    source = sorted(map(float, source))
    sums = {}
    for t, s, w in g.bilinear(source, target):
        assert 0 <= w <= 1 and 0 <= s < len(source)
        sums[t] = sums.get(t, 0) + w
    assert all(abs(x - 1) < 1e-12 for x in sums.values()) and len(sums) == len(target)
    for t, s in g.nearest(source, target):
        assert abs(source[s] - target[t]) == min(abs(x - target[t]) for x in source)


def test_axes():
    assert g.nearest([0, 1, 2], [0.5, 1.5]) == [(0, 0), (1, 1)]
    assert g.midpoint_edges([0.0, 1.0]) == [-0.5, 0.5, 1.5]
    assert g.target_axis([0, 1, 2], 0.5) == [0, 0.5, 1, 1.5, 2]
    assert Grid.of([60.0, 61.0], [0, 1]).same(Grid.of([60.0005, 61.0], [0, 1]))
    assert not Grid.of([60.0, 61.0], [0, 1]).same(Grid.of([60.01, 61.0], [0, 1]))
    with pytest.raises(ValueError):
        g.target_axis([0, 1], 0)
