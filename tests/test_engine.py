"""Gaps, guards, names, trees, digests and the store; the golden values are in test_zonal.py."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalith.functions.grid import Grid, areas, cell_area, midpoint_edges
from zonalith.operators import reduce as r
from zonalith.operators import resample as rs
from zonalith.operators import tree as tr
from zonalith.operators.stencil import Stencil, coverage
from zonalith.plans import store as st
from zonalith.sources import fields, polygons

ROOT = Path(__file__).parent.parent
NAN = float("nan")
SOURCE, TARGET = Grid.of(range(4), range(3)), Grid.of(np.linspace(0, 3, 8), np.linspace(0, 2, 6))


def boxes(spark, *rows):
    return polygons.edges_of(polygons.boxes(spark.createDataFrame(list(rows), "geom_key string, xmin double, ymin double, xmax double, ymax double")))


def field(spark, values, names="b int, lat_idx int, lon_idx int, v double"):
    return spark.createDataFrame([(0, i, j, v) for i, row in enumerate(values) for j, v in enumerate(row)], names)


def got(df, key="geom_key", value="v"):
    return {x[key]: x[value] for x in df.collect()}


@pytest.fixture(scope="module")
def edges(spark):
    return boxes(spark, ("a", 0.2, 0.2, 1.8, 2.8), ("b", 1.0, 0.0, 2.0, 1.5))


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(0).uniform(0, 10, (4, 3)).tolist()


def dense(resampler):
    """The resampling as a plain matrix, stage by stage."""

    def full(kind):
        one = []
        for axis, n in zip(resampler.factors, ((len(resampler.target.lats), len(resampler.source.lats)), (len(resampler.target.lons), len(resampler.source.lons))), strict=True):
            m = np.zeros(n if kind != "A" else n[::-1])
            for t, row in enumerate(axis[kind]):
                for s, w in row.items():
                    m[t, s] = w
            one.append(m)
        return np.kron(*one)

    b, a, p = full("B"), full("A"), full("P")
    y = term = b
    for _ in range(1, resampler.iterations):
        term = term - b @ a @ term
        y = y + term
    return y + p @ (np.eye(b.shape[1]) - a @ y)


@pytest.mark.parametrize("iterations", [1, 2, 5])
@pytest.mark.parametrize("target", [TARGET, Grid.of([0.5, 2.5], [0.4, 1.0])])
def test_matrix_and_slices_against_plain_products(spark, values, target, iterations, monkeypatch):
    resampler = rs.Resampler(SOURCE, target, iterations)
    plain = dense(resampler)
    m = np.zeros(plain.shape)
    for x in rs.matrix(spark, resampler).collect():
        m[x["target_cell"], x["cell_id"]] = x["weight"]
    assert np.abs(m - plain).max() < 1e-9
    expected = (plain @ np.array(values).reshape(-1)).reshape(len(target.lats), -1)
    for most in (rs.MOST_CELLS, 1):  # as arrays, and by joins
        monkeypatch.setattr(rs, "MOST_CELLS", most)
        found = rs.resample(field(spark, values), resampler, ["b"], ["v"]).collect()
        assert len(found) == expected.size and all(x["v"] == pytest.approx(expected[x["lat_idx"], x["lon_idx"]]) for x in found)


def test_plans_do_not_grow_with_iterations(spark, values):
    size = [rs.fused(Stencil.build(boxes(spark, ("a", 0.2, 0.2, 1.8, 2.8)), TARGET, check=False).weights, rs.Resampler(SOURCE, TARGET, n))._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") for n in (1, 6)]
    assert size[0] == size[1]


@pytest.mark.parametrize("gap", [None, NAN, "missing"])
def test_gaps_spread_in_operators_and_matrices(spark, edges, values, gap, monkeypatch):
    """A constant field of 10 keeps its mean only where it is whole."""
    f = field(spark, [[10.0] * 3] * 4)
    at = (F.col("lat_idx") == 2) & (F.col("lon_idx") == 1)
    f = f.filter(~at) if gap == "missing" else f.withColumn("v", F.when(~at, F.col("v")).otherwise(F.lit(gap)))
    own = Stencil.build(edges, SOURCE)
    for how in ("mean", "sum"):
        out = got(r.reduce_with_operator(f, r.operator(own, SOURCE), own.row_sums(), ["b"], ["v"], how=how))
        assert math.isnan(out["a"]) and not math.isnan(out["b"])  # b does not reach the gap
    far = boxes(spark, ("c", -0.4, -0.4, 0.4, 0.4))
    s = Stencil.build(far, SOURCE)
    assert got(r.reduce_with_operator(f, r.operator(s, SOURCE), s.row_sums(), ["b"], ["v"]))["c"] == pytest.approx(10)
    assert r.has_gaps(f, ["v"]) == (gap != "missing")
    resampler = rs.Resampler(SOURCE, TARGET, 2)
    lost = {}
    for most in (rs.MOST_CELLS, 1):
        monkeypatch.setattr(rs, "MOST_CELLS", most)
        lost[most] = {(x["lat_idx"], x["lon_idx"]) for x in rs.resample(f, resampler, ["b"], ["v"]).collect() if math.isnan(x["v"])}
    assert len({frozenset(x) for x in lost.values()}) == 1 and lost[1]


def test_names_that_clash_and_names_of_dims(spark, edges, values):
    plain = got(r.reduce_field(field(spark, values), edges, SOURCE, ["b"], ["v"], resolution=0.5))
    odd = field(spark, values, "t int, y int, x int, w double").withColumn("_y", F.lit(1)).withColumn("s", F.lit("u"))
    out = r.reduce_field(odd, edges, SOURCE, ["t", "s", "_y"], ["w"], resolution=0.5, dims=("y", "x", "zone"))
    assert out.columns == ["t", "s", "_y", "zone", "w"] and got(out, "zone", "w") == pytest.approx(plain)
    with pytest.raises(ValueError, match="reserved"):
        r.reduce_field(field(spark, values, "_z_b int, lat_idx int, lon_idx int, v double"), edges, SOURCE, ["_z_b"], ["v"])
    e = spark.createDataFrame([("a", "p"), ("b", "p")], "child string, parent string")
    leaves = spark.createDataFrame([(1, "x", "a", 2.0), (1, "x", "b", 4.0)], "depth int, leaf string, geom_key string, weight double")
    assert got(tr.roll_up(leaves, e, ["depth", "leaf"], ["weight"], weighted=False), value="weight") == {"a": 2, "b": 4, "p": 3}


def test_grids_that_differ(spark, edges, values):
    s = Stencil.build(edges, TARGET)
    f, op = field(spark, values), r.operator(s, SOURCE, 2)
    one = got(r.reduce_with_operator(f, op, s.row_sums(), ["b"], ["v"], grid=SOURCE, source=SOURCE))
    assert got(r.reduce_with_stencil(f, s, ["b"], ["v"], grid=SOURCE, iterations=2)) == pytest.approx(one)
    other = Grid.of(range(4), [0, 1, 2.5])
    with pytest.raises(ValueError, match="operator's"):
        r.reduce_with_operator(f, op, s.row_sums(), ["b"], ["v"], grid=other, source=SOURCE)
    with pytest.raises(ValueError):
        rs.apply_matrix(f, op, rs.Resampler(SOURCE, TARGET), other, ["b"], ["v"])
    with pytest.raises(ValueError, match="no polygons"):
        Stencil.build(edges.limit(0), SOURCE)


def test_weights_over_missing_dimensions(spark, edges):
    f = field(spark, [[10.0, 10.0], [20.0, 20.0]])
    s = Stencil.build(boxes(spark, ("a", -0.4, -25.0, 1.4, 85.0)), Grid.of([0, 60], [0, 1]), spherical=False)
    assert got(r.reduce_with_stencil(f, s, ["b"], ["v"], weight="latitude"))["a"] == pytest.approx(20)
    by_row = spark.createDataFrame([(0, 1.0), (1, 9.0)], "lat_idx int, u double")
    share = [x["w"] for x in s.weights.groupBy("lat_idx").agg(F.sum("weight").alias("w")).sort("lat_idx").collect()]
    assert got(r.reduce_with_stencil(f, s, ["b"], ["v"], weight="u", weights=by_row))["a"] == pytest.approx((10 * share[0] + 180 * share[1]) / (share[0] + 9 * share[1]))
    one = spark.createDataFrame([(3.0,)], "u double")
    assert got(r.reduce_with_stencil(f, s, ["b"], ["v"], weight="u", weights=one, how="sum"))["a"] == pytest.approx(3 * (10 * share[0] + 20 * share[1]))
    for bad in ({"weight": "u"}, {"weight": "u", "weights": by_row.withColumn("z", F.lit(1))}, {"weight": "u", "weights": by_row.select("u")}):
        with pytest.raises(ValueError):
            r.reduce_with_stencil(f, s, ["b"], ["v"], **bad)


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_coverage_of_polygons_of_many_corners(spark):
    """Whole cells inside, and edges that leave the grid on any side."""
    grid = Grid.of(np.arange(0.5, 40), np.arange(0.5, 40))
    star = [(20 + (12 + 5 * (k % 2)) * math.cos(2 * math.pi * k / 5000), 20 + (12 + 5 * (k % 2)) * math.sin(2 * math.pi * k / 5000)) for k in range(5000)]
    rows = coverage(polygons.edges_of(spark.createDataFrame([("a", False, star)], polygons.RINGS.format(key="string"))), grid).collect()
    assert sum(x["coverage"] for x in rows) == pytest.approx(shoelace(star)) and all(0 < x["coverage"] < 1 + 1e-9 for x in rows)
    for box, cells in (((-5, -5, 50, 50), 1600), ((-5, 10, 3, 12.5), 7.5), ((38, 30, 60, 60), 20), ((10, -9, 12, 1.5), 3), ((10, 41, 12, 45), 0)):
        found = coverage(boxes(spark, ("a", *map(float, box))), grid).collect()
        assert sum(x["coverage"] for x in found) == pytest.approx(cells) and all(0 <= x["lat_idx"] < 40 for x in found)


@pytest.mark.parametrize("driver", [100_000, 0])
def test_trees_on_the_driver_and_in_the_cluster(spark, driver):
    build = lambda rows, **how: tr.Tree.build(spark.createDataFrame(rows, "child string, parent string, weight double"), driver_edges=driver, **how)
    chain = [(f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(300)]  # deeper than any fixed number of rounds
    found = {x["node"]: x for x in build([*chain, ("x", "n300", 3.0)]).rows.filter("leaf = 'n000'").collect()}
    assert len(found) == 301 and found["n300"]["weight"] == pytest.approx(0.25) and found["n300"]["depth"] == 300 and found["n000"]["depth"] == 0
    for rows in ([("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], [("x", "y", 1.0), ("y", "x", 1.0), ("a", "p", 1.0)], [("x", "x", 1.0)]):
        with pytest.raises(ValueError, match="cycle"):
            build(rows)
    for rows in ([("a", "p", 1.0), ("a", "q", 1.0)], [("a", "p", 0.0)], [("a", "p", NAN)], [("a", "p", None)]):
        with pytest.raises(ValueError):
            build(rows)
    own = {(x["node"], x["leaf"]): x["weight"] for x in build([("a", "p", 1.0), ("b", "p", 3.0), ("p", "r", 2.0), ("c", "r", 6.0)]).rows.collect()}
    assert own == pytest.approx({("a", "a"): 1, ("b", "b"): 1, ("c", "c"): 1, ("p", "a"): 0.25, ("p", "b"): 0.75, ("r", "a"): 0.0625, ("r", "b"): 0.1875, ("r", "c"): 0.75})


def test_keys_of_several_levels(spark):
    rows = [(("x", "a"), ("x", "ALL"), 1.0), (("x", "b"), ("x", "ALL"), 2.0), (("y", "a"), ("y", "ALL"), 5.0)]
    e = spark.createDataFrame(rows, "child struct<s:string,r:string>, parent struct<s:string,r:string>, weight double")
    leaves = e.select(F.lit(1).alias("b"), F.col("child").alias("key"), F.col("weight").alias("v"))
    out = tr.levels(tr.roll_up(leaves, e, ["b"], ["v"], how="sum", weighted=False, key="key"), "key", ["scenario", "region"])
    assert {(x["scenario"], x["region"]): x["v"] for x in out.collect()} == {("x", "a"): 1, ("x", "b"): 2, ("y", "a"): 5, ("x", "ALL"): 3, ("y", "ALL"): 5}
    mixed = spark.createDataFrame([(["BR", "SP", "m"], ["BR", "SP"]), (["BR", "SP"], ["BR"])], "child array<string>, parent array<string>")
    assert [tuple(x["node"]) for x in tr.Tree.build(mixed, weighted=False).nodes().collect()] == [("BR", "SP", "m"), ("BR", "SP"), ("BR",)]


def test_digests(spark, edges):
    up, down = Grid.of([0, 1, 2], [0, 1]), Grid.of([2, 1, 0], [0, 1])
    assert st.grid_digest(up) == st.grid_digest(down) != st.grid_digest(Grid.of([0, 1, 2], [0, 2]))
    assert st.geom_digest(edges) == st.geom_digest(edges.orderBy(F.desc("xa")).select(*reversed(edges.columns)))
    assert st.geom_digest(edges) != st.geom_digest(edges.withColumn("geom_key", F.concat("geom_key", F.lit("2"))))
    assert st.stencil_digest(up, edges) == st.stencil_digest(down, edges) != st.stencil_digest(up, edges, spherical=False)
    one, two = rs.Resampler(SOURCE, TARGET), rs.Resampler(SOURCE, TARGET, 2)
    assert st.resampler_digest(one) != st.resampler_digest(two) != st.resampler_digest(rs.Resampler(TARGET, SOURCE, 2))
    assert st.operator_digest("x", up) == st.operator_digest("x", down) != st.operator_digest("x", up, 2)
    e = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 2.0)], "child string, parent string, weight double")
    assert len({st.tree_digest(e), st.tree_digest(e, "sum"), st.tree_digest(e, weighted=False), st.tree_digest(e.withColumn("weight", F.col("weight") + 1))}) == 4
    assert st.tree_digest(e) == st.tree_digest(e.orderBy(F.desc("child")))


def test_store_skips_builds_and_survives_force(spark, tmp_path, edges, values, monkeypatch):
    store = st.OperatorStore(spark, f"file://{tmp_path}")
    stencil = store.stencil(TARGET, edges)
    key = st.stencil_digest(TARGET, edges)
    op, tree = store.operator(stencil, key, SOURCE, 2), store.tree(e := spark.createDataFrame([("a", "p"), ("b", "p")], "child string, parent string"), weighted=False)
    m = store.resampler(rs.Resampler(SOURCE, TARGET))
    before = [x.sort(*x.columns).collect() for x in (stencil.weights, op, tree.rows, m)]
    for owner, name in ((Stencil, "build"), (tr.Tree, "build"), (r, "operator"), (rs, "matrix")):
        monkeypatch.setattr(owner, name, lambda *a, **b: pytest.fail("built again"))
    again = [store.stencil(TARGET, edges).weights, store.operator(stencil, key, SOURCE, 2), store.tree(e, weighted=False).rows, store.resampler(rs.Resampler(SOURCE, TARGET))]
    assert [x.sort(*x.columns).collect() for x in again] == before
    made = spark.createDataFrame([("a", 1.0)], "k string, w double")
    reader = store.get_or_build("tree", "k", lambda: made)
    for n in range(3):
        assert store.get_or_build("tree", "k", lambda: made, force=True).collect() == [("a", 1.0)]
        assert len(list((tmp_path / "tree/k").iterdir())) == 2
        assert n or reader.collect() == [("a", 1.0)]  # one forced build leaves what a reader has open
    (tmp_path / "tree/k/99999999999999999999-unfinished").mkdir()
    assert store.get_or_build("tree", "k", lambda: pytest.fail("built again")).collect() == [("a", 1.0)]
    with pytest.raises(ValueError):
        store.get_or_build("other", "k", lambda: made)


def test_axes_and_messages(spark):
    grid = Grid.of([0, 1, 3], [0, 2, 3, 7])
    y, x = midpoint_edges(grid.lats), midpoint_edges(grid.lons)
    found = {x["cell_id"]: x["area"] for x in areas(spark, grid).collect()}
    rows = [(4 * i + j, y[i], y[i + 1], x[j], x[j + 1]) for i in range(3) for j in range(4)]
    plain = spark.createDataFrame(rows, "cell_id long, a double, b double, c double, d double").select("cell_id", cell_area(*map(F.col, "abcd")).alias("area"))
    assert found == pytest.approx({x["cell_id"]: x["area"] for x in plain.collect()})
    m = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "param string, number int")
    assert fields.selected(m, param="t", number=[2, 3]).collect() == [("t", 2)]
    with pytest.raises(ValueError):
        fields.selected(m, level=1)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """As the driver has it: the subpackage, its tests and the pipeline are gone, or only the first two."""
    for gone in (["zonalith/llm", "corpus_pipeline.py"], ["zonalith/llm"]):
        at = tmp_path / str(len(gone))
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *(Path(x).name for x in gone)))
        code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()), set(q) ^ set(e.oracle_sql()); assert len(q) > 50 and not any(x.startswith('op1') for x in q)"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, timeout=120)
