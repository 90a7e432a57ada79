"""The queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalith.functions import grid as g
from zonalith.functions.grid import Grid
from zonalith.operators import reduce as r
from zonalith.operators import tree as tr
from zonalith.operators.resample import Resampler, apply_matrix, matrix, resample
from zonalith.operators.stencil import Stencil, coverage, empty_keys
from zonalith.plans.store import OperatorStore, shared_dir, stencil_digest
from zonalith.sources import fields, polygons

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The 8 x 8 grid that an embedding's 64 numbers stand on.
GRID = Grid.of([-40 + 10 * i for i in range(8)], [10 * i for i in range(8)])
BATCH = ["vec_id", "label"]


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- relations that the queries share ---


def _field(spark: SparkSession, d: str) -> DataFrame:
    return fields.unpacked(_read(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding", 8)


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return fields.masked(_field(spark, d), (F.col("lat_idx") * 8 + F.col("lon_idx") + F.col("vec_id")) % 10 < 3)


def _corner(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _read(spark, d, "nation").select(F.col("n_name").alias("geom_key"), (-3 + 14 * (k % 5)).cast("double").alias("x0"), (-43 + 14 * F.floor(k / 5)).cast("double").alias("y0"), (k % 5 == 0).alias("hole"))


def _ring(*at: tuple[int, int]) -> Column:
    return F.array(*[F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y")) for x, y in at])


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    p = _corner(spark, d)
    outer = p.select("geom_key", F.lit(False).alias("is_hole"), _ring((0, 0), (13, 2), (5, 12)).alias("pts"))
    holes = p.filter("hole").select("geom_key", F.lit(True).alias("is_hole"), _ring((5, 3), (6, 6), (8, 3)).alias("pts"))
    return polygons.edges_of(outer.unionByName(holes))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    p = _corner(spark, d)
    return polygons.edges_of(polygons.boxes(p.select("geom_key", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + 13).alias("xmax"), (F.col("y0") + 12).alias("ymax"))))


def _tree_edges(spark: SparkSession, d: str) -> DataFrame:
    n = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("weight"))
    low = n.join(c, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), "weight")
    top = _read(spark, d, "region").select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"), F.lit(1.0).alias("weight"))
    return low.unionByName(top)


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("geom_key"), "n_nationkey", "n_regionkey").agg(F.avg("c_acctbal").alias("v"))


def _num(c: str | Column, digits: int = 6, alias: str | None = None) -> Column:
    """Rounded, null for NaN, and without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), F.round(col, digits) + F.lit(0.0)).alias(alias or c)


# --- the same relations in SQL ---

_R2 = f"{g.RADIUS**2!r}::DOUBLE"
_EMB = "emb AS (SELECT vec_id, label, (i // 8)::INT AS lat_idx, (i % 8)::INT AS lon_idx, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"
_MASKED = "emb_m AS (SELECT vec_id, label, lat_idx, lon_idx, CASE WHEN (lat_idx * 8 + lon_idx + vec_id) % 10 < 3 THEN NULL ELSE v END AS v FROM emb)"
_P = "p AS (SELECT n_name AS geom_key, (-3 + 14 * (n_nationkey % 5))::DOUBLE AS x0, (-43 + 14 * (n_nationkey // 5))::DOUBLE AS y0, n_nationkey % 5 = 0 AS hole FROM nation)"
_TRI = (
    _P
    + """, edge AS (
  SELECT geom_key, x0 + a AS xa, y0 + b AS ya, x0 + c AS xb, y0 + d AS yb FROM p, (VALUES (0, 0, 13, 2), (13, 2, 5, 12), (5, 12, 0, 0)) t(a, b, c, d)
  UNION ALL SELECT geom_key, x0 + a, y0 + b, x0 + c, y0 + d FROM p, (VALUES (5, 3, 6, 6), (6, 6, 8, 3), (8, 3, 5, 3)) t(a, b, c, d) WHERE hole)"""
)


def _cells(step: float = 10, n: int = 8) -> str:
    h = step / 2
    return f"cell AS (SELECT i::INT AS lat_idx, j::INT AS lon_idx, -40 - {h}::DOUBLE + {step} * i AS cy, -{h}::DOUBLE + {step} * j AS cx, {step}::DOUBLE AS st FROM (SELECT unnest(range({n})) AS i), (SELECT unnest(range({n})) AS j))"


def _cover(step: float = 10, n: int = 8, spherical: bool = True) -> str:
    """st(geom_key, lat_idx, lon_idx, coverage, w) of edge(...), by the signed area of each edge in each cell."""
    j = lambda p, q: f"CASE WHEN {p} >= 0 AND {q} >= 0 THEN (hx - lx) * ({p} + {q}) / 2 WHEN {p} <= 0 AND {q} <= 0 THEN 0 ELSE (hx - lx) * greatest({p}, {q}) * greatest({p}, {q}) / (2 * abs({p} - {q})) END"
    area = f"{_R2} * (sin(radians(cy + st)) - sin(radians(cy))) * radians(st)" if spherical else "1.0::DOUBLE"
    return f"""{_cells(step, n)}, cut AS (
      SELECT *, ya + (lx - xa) * (yb - ya) / (xb - xa) AS yl, ya + (hx - xa) * (yb - ya) / (xb - xa) AS yh
      FROM (SELECT *, greatest(least(xa, xb), cx) AS lx, least(greatest(xa, xb), cx + st) AS hx FROM edge, cell WHERE xa <> xb) WHERE hx > lx
    ), st AS (
      SELECT geom_key, lat_idx, lon_idx, sum(CASE WHEN xb > xa THEN -1 ELSE 1 END * (({j('(yl - cy)', '(yh - cy)')}) - ({j('(yl - cy - st)', '(yh - cy - st)')}))) / any_value(st * st) AS coverage, any_value({area}) AS area
      FROM cut GROUP BY geom_key, lat_idx, lon_idx
    ), w AS (SELECT geom_key, lat_idx, lon_idx, coverage, coverage * area AS w FROM st WHERE coverage > 1e-12)"""


def _zonal(field: str, value: str = "v", extra: str = "", how: str = "mean", batch: str = "vec_id, label") -> str:
    x = f"sum(w * {value}{extra}) / sum(CASE WHEN {value} IS NOT NULL THEN w{extra} END)" if how == "mean" else f"coalesce(sum(w * {value}{extra}), 0) / 1e12"
    return f"SELECT {batch}, geom_key, round({x}, 6) + 0.0::DOUBLE AS v FROM {field} JOIN w USING (lat_idx, lon_idx) GROUP BY {batch}, geom_key"


# --- axes and factors ---


@query(f"SELECT a AS axis, i::INT AS idx, c::DOUBLE AS centre, c - 5.0::DOUBLE AS lo, c + 5.0::DOUBLE AS hi FROM (SELECT 'lat' AS a, i, -40 + 10 * i AS c FROM (SELECT unnest(range(8)) AS i) UNION ALL SELECT 'lon', i, 10 * i FROM (SELECT unnest(range(8)) AS i))")
def grid_edges(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = (g.axis_frame(spark, c).select(F.lit(a).alias("axis"), "*") for a, c in (("lat", GRID.lats), ("lon", GRID.lons)))
    return lat.unionByName(lon)


@query(f"WITH {_cells()} SELECT (lat_idx * 8 + lon_idx)::BIGINT AS cell_id, round({_R2} * (sin(radians(cy + 10)) - sin(radians(cy))) * radians(10) / 1e12, 6) AS area FROM cell")
def grid_cell_area(spark: SparkSession, d: str) -> DataFrame:
    return g.areas(spark, GRID).select("cell_id", F.round(F.col("area") / 1e12, 6).alias("area"))


@query("SELECT i::BIGINT AS cell_id, 1.0::DOUBLE AS area FROM (SELECT unnest(range(64)) AS i)")
def cell_area_planar(spark: SparkSession, d: str) -> DataFrame:
    return g.areas(spark, GRID, spherical=False).select("cell_id", "area")


def _axis_query(step: float, n: int) -> None:
    def target_axis(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame(list(enumerate(g.target_axis(GRID.lats, step))), "idx int, centre double")

    target_axis.__name__ = "target_axis_refine" if step < 10 else "target_axis_coarsen"
    query(f"SELECT i::INT AS idx, (-40 + {step} * i)::DOUBLE AS centre FROM (SELECT unnest(range({n})) AS i)")(target_axis)


_axis_query(4, 18)
_axis_query(30, 3)


def _factors(step: float, n: int) -> str:
    """fb(t, s, w) and fp(t, s) of either axis of the refined grid."""
    return f"""pos AS (SELECT t::INT AS t, t * {step}::DOUBLE / 10 AS x FROM (SELECT unnest(range({n})) AS t)),
    lo AS (SELECT t, least(greatest(ceil(x) - 1, 0), 6)::INT AS s, x FROM pos),
    fb AS (SELECT t, s + k AS s, CASE WHEN k = 0 THEN 1 - least(greatest(x - s, 0), 1) ELSE least(greatest(x - s, 0), 1) END AS w FROM lo, (VALUES (0), (1)) v(k)),
    fp AS (SELECT t, least(greatest(ceil(x - 0.5), 0), 7)::INT AS s FROM pos)"""


@query(f"WITH {_factors(4, 18)} SELECT t, s, round(w, 9) AS w FROM fb")
def bilinear_weights(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(g.bilinear(GRID.lats, g.target_axis(GRID.lats, 4)), "t int, s int, w double").withColumn("w", F.round("w", 9))


@query(f"WITH {_factors(5, 15)} SELECT t, s FROM fp")
def nearest_parent(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(g.nearest(GRID.lats, g.target_axis(GRID.lats, 5)), "t int, s int")


@query("SELECT (i)::INT AS idx, round(-45 + 10 * (i // 3) + 10 * (i % 3 + 0.5) / 3, 9)::DOUBLE AS centre FROM (SELECT unnest(range(24)) AS i)")
def axis_subdivided(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(g.subdivide(GRID.lats, 3))), "idx int, centre double").withColumn("centre", F.round("centre", 9))


# --- coverage and stencils ---


@query(f"WITH {_TRI}, {_cover()} SELECT geom_key, (lat_idx * 8 + lon_idx)::BIGINT AS cell_id, round(coverage, 9) AS coverage FROM w")
def coverage_triangles(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_triangles(spark, d), GRID).select("geom_key", "cell_id", F.round("coverage", 9).alias("coverage"))


@query(f"WITH {_P}, {_cells()} SELECT geom_key, (lat_idx * 8 + lon_idx)::BIGINT AS cell_id, round((least(x0 + 13, cx + 10) - greatest(x0, cx)) * (least(y0 + 12, cy + 10) - greatest(y0, cy)) / 100, 9) AS coverage FROM p, cell WHERE least(x0 + 13, cx + 10) > greatest(x0, cx) AND least(y0 + 12, cy + 10) > greatest(y0, cy)")
def coverage_boxes(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_boxes(spark, d), GRID).select("geom_key", "cell_id", F.round("coverage", 9).alias("coverage"))


@query(f"WITH {_P} SELECT geom_key, CASE WHEN hole THEN 68.5::DOUBLE ELSE 73.0::DOUBLE END AS area FROM p")
def coverage_holes(spark: SparkSession, d: str) -> DataFrame:
    """The polygons lie inside the grid, so what is covered adds up to their areas, without their holes."""
    return coverage(_triangles(spark, d), GRID).groupBy("geom_key").agg(F.round(100 * F.sum("coverage"), 6).alias("area"))


@query(f"WITH {_TRI}, {_cover()} SELECT geom_key, (lat_idx * 8 + lon_idx)::BIGINT AS cell_id, round(w / sum(w) OVER (PARTITION BY geom_key), 9) AS share FROM w")
def coverage_normalized(spark: SparkSession, d: str) -> DataFrame:
    return Stencil.build(_triangles(spark, d), GRID).normalised().withColumn("share", F.round("share", 9))


@query(f"WITH {_TRI}, {_cover()} SELECT geom_key, (lat_idx * 8 + lon_idx)::BIGINT AS cell_id, round(w / 1e12, 9) AS weight FROM w")
def stencil_weights(spark: SparkSession, d: str) -> DataFrame:
    return Stencil.build(_triangles(spark, d), GRID).weights.select("geom_key", "cell_id", F.round(F.col("weight") / 1e12, 9).alias("weight"))


@query(f"WITH {_TRI}, {_cover()} SELECT geom_key, round(sum(w) / 1e12, 9) AS row_sum FROM w GROUP BY geom_key")
def stencil_row_sums(spark: SparkSession, d: str) -> DataFrame:
    return Stencil.build(_triangles(spark, d), GRID).row_sums().withColumn("row_sum", F.round(F.col("row_sum") / 1e12, 9))


@query(f"WITH {_TRI}, e2 AS (SELECT * FROM edge UNION ALL SELECT 'far', 100 + a, 100 + b, 100 + c, 100 + d FROM (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) t(a, b, c, d)) SELECT geom_key FROM e2 GROUP BY geom_key HAVING max(greatest(xa, xb)) <= -5 OR min(least(xa, xb)) >= 75 OR max(greatest(ya, yb)) <= -45 OR min(least(ya, yb)) >= 35")
def empty_overlap_keys(spark: SparkSession, d: str) -> DataFrame:
    far = spark.createDataFrame([("far", 100.0, 100.0, 101.0, 101.0)], "geom_key string, xmin double, ymin double, xmax double, ymax double")
    edges = _triangles(spark, d).unionByName(polygons.edges_of(polygons.boxes(far)))
    return empty_keys(edges, Stencil.build(edges, GRID, check=False))


# --- reduction ---


def _reduced(field: DataFrame, spark: SparkSession, d: str, **how) -> DataFrame:
    out = r.reduce_with_stencil(field, Stencil.build(_triangles(spark, d), GRID), BATCH, ["v"], small=True, **how)
    return out.select(*BATCH, "geom_key", _num(F.col("v") / 1e12 if how.get("how") == "sum" else F.col("v"), alias="v"))


@query(f"WITH {_EMB}, {_TRI}, {_cover()} {_zonal('emb')}")
def reduce_mean(spark: SparkSession, d: str) -> DataFrame:
    return _reduced(_field(spark, d), spark, d)


@query(f"WITH {_EMB}, {_TRI}, {_cover()} {_zonal('emb', how='sum')}")
def reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    return _reduced(_field(spark, d), spark, d, how="sum")


@query(f"WITH {_EMB}, {_TRI}, {_cover(spherical=False)} {_zonal('emb')}")
def reduce_planar(spark: SparkSession, d: str) -> DataFrame:
    return r.reduce_field(_field(spark, d), _triangles(spark, d), GRID, BATCH, ["v"], spherical=False).select(*BATCH, "geom_key", _num("v"))


@query(f"WITH {_EMB}, {_TRI}, {_cover()}, l AS (SELECT label, lat_idx, lon_idx, avg(v) AS v FROM emb GROUP BY ALL) {_zonal('l', batch='label')}")
def reduce_batch_label(spark: SparkSession, d: str) -> DataFrame:
    field = _field(spark, d).groupBy("label", "lat_idx", "lon_idx").agg(F.avg("v").alias("v"))
    return r.reduce_field(field, _triangles(spark, d), GRID, ["label"], ["v"]).select("label", "geom_key", _num("v"))


@query(f"WITH {_EMB}, {_MASKED}, {_TRI}, {_cover()} {_zonal('emb_m')}")
def reduce_masked_mean(spark: SparkSession, d: str) -> DataFrame:
    return _reduced(_masked(spark, d), spark, d)


@query(f"WITH {_EMB}, {_MASKED}, {_TRI}, {_cover()} {_zonal('emb_m', how='sum')}")
def reduce_masked_sum(spark: SparkSession, d: str) -> DataFrame:
    return _reduced(_masked(spark, d), spark, d, how="sum")


@query(f"WITH {_EMB}, n AS (SELECT vec_id, label, lat_idx, lon_idx, CASE WHEN vec_id % 50 <> 0 THEN v END AS v FROM emb), {_TRI}, {_cover()} {_zonal('n')}")
def reduce_all_nan(spark: SparkSession, d: str) -> DataFrame:
    return _reduced(fields.masked(_field(spark, d), F.col("vec_id") % 50 == 0), spark, d)


def _weighted(spark: SparkSession, d: str, gaps: bool) -> DataFrame:
    cell = _read(spark, d, "part").groupBy((F.col("p_partkey") % 64).alias("cell")).agg(F.sum("p_retailprice").alias("u"))
    u = F.when(F.col("cell") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("u")) if gaps else F.col("u")
    by_cell = cell.select(F.floor(F.col("cell") / 8).cast("int").alias("lat_idx"), (F.col("cell") % 8).cast("int").alias("lon_idx"), u.alias("u"))
    return _reduced(_field(spark, d), spark, d, weight="u", weights=by_cell)


@query(f"WITH {_EMB}, {_TRI}, {_cover()}, el AS (SELECT *, -40 + 10 * lat_idx + 50 AS u FROM emb) {_zonal('el', extra=' * u')}")
def reduce_weighted_by_latitude(spark: SparkSession, d: str) -> DataFrame:
    """A coordinate of the grid as weight (raised above 0), spread over longitudes and slices."""
    field = r.with_weight(_field(spark, d), "latitude", grid=GRID).withColumn("latitude", F.col("latitude") + 50)
    return _reduced(field, spark, d, weight="latitude")


@query(f"WITH {_EMB}, {_TRI}, {_cover()}, el AS (SELECT *, 1 + label AS u FROM emb) {_zonal('el', extra=' * u', how='sum')}")
def reduce_weighted_sum_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """A weight that lacks both dimensions of the grid."""
    by_label = _read(spark, d, "embeddings").select("label").distinct().withColumn("u", (1 + F.col("label")).cast("double"))
    return _reduced(_field(spark, d), spark, d, weight="u", weights=by_label, how="sum")


@query(f"WITH {_EMB}, {_TRI}, {_cover()} SELECT vec_id, label, nation, v FROM ({_zonal('emb').replace('geom_key, round', 'geom_key AS nation, round')})")
def reduce_named_dims(spark: SparkSession, d: str) -> DataFrame:
    field = _field(spark, d).withColumnsRenamed({"lat_idx": "row", "lon_idx": "col"})
    return r.reduce_with_stencil(field, Stencil.build(_triangles(spark, d), GRID), BATCH, ["v"], dims=("row", "col", "nation")).select(*BATCH, "nation", _num("v"))


_U = "u AS (SELECT (p_partkey % 64) AS cell, sum(p_retailprice) AS u FROM part GROUP BY 1), eu AS (SELECT emb.*, u{gap} AS u FROM emb JOIN u ON lat_idx * 8 + lon_idx = cell)"


@query(f"WITH {_EMB}, {_U.format(gap='')}, {_TRI}, {_cover()} {_zonal('eu', extra=' * u')}")
def reduce_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, False)


@query(f"WITH {_EMB}, {_U.format(gap=' * CASE WHEN cell % 9 <> 0 THEN 1 END')}, {_TRI}, {_cover()} {_zonal('eu', extra=' * u')}")
def reduce_weighted_nan_weight(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, True)


_LI = "li AS (SELECT l_returnflag || l_linestatus AS slice, (l_partkey % 16)::INT AS lat_idx, (l_orderkey % 16)::INT AS lon_idx, avg(l_extendedprice) AS price, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2, 3)"


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    at = [F.concat("l_returnflag", "l_linestatus").alias("slice"), (F.col("l_partkey") % 16).cast("int").alias("lat_idx"), (F.col("l_orderkey") % 16).cast("int").alias("lon_idx")]
    return _read(spark, d, "lineitem").groupBy(*at).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("quantity"))


_FINE = Grid.of([-40 + 5 * i for i in range(16)], [5 * i for i in range(16)])


@query(f"WITH {_LI}, {_TRI}, {_cover(5, 16)} SELECT slice, geom_key, round(sum(w * price) / sum(w), 6) AS price, round(sum(w * quantity) / sum(w), 6) AS quantity FROM li JOIN w USING (lat_idx, lon_idx) GROUP BY slice, geom_key")
def reduce_multi_var(spark: SparkSession, d: str) -> DataFrame:
    """Two values in one join, on a field that may lack cells."""
    out = r.reduce_field(_sparse(spark, d), _triangles(spark, d), _FINE, ["slice"], ["price", "quantity"])
    return out.select("slice", "geom_key", _num("price"), _num("quantity"))


@query(f"WITH {_LI}, {_TRI}, {_cover(5, 16)} SELECT slice, geom_key, round(sum(w * price) / 1e12, 6) AS price FROM li JOIN w USING (lat_idx, lon_idx) GROUP BY slice, geom_key")
def reduce_sparse_lineitem(spark: SparkSession, d: str) -> DataFrame:
    out = r.reduce_field(_sparse(spark, d), _triangles(spark, d), _FINE, ["slice"], ["price"], how="sum")
    return out.select("slice", "geom_key", _num(F.col("price") / 1e12, alias="price"))


# --- resampling ---


def _resampled(step: float, n: int, iterations: int = 1, field: str = "emb") -> str:
    """rs(vec_id, label, lat_idx, lon_idx, v): the stages written out, cells under one number c (vec_id tells slices apart)."""

    def b(x: str) -> str:
        return f"SELECT vec_id, o AS c, sum(v * w) AS v FROM {x} JOIN f2b USING (c) GROUP BY vec_id, o"

    def mean(x: str) -> str:
        return f"SELECT vec_id, s AS c, avg(v) AS v FROM {x} JOIN f2p USING (c) GROUP BY vec_id, s"

    out = [_factors(step, n)]
    out += [f"f2b AS MATERIALIZED (SELECT (a.s * 8 + b.s)::INT AS c, (a.t * {n} + b.t)::INT AS o, a.w * b.w AS w FROM fb a, fb b)"]
    out += [f"f2p AS MATERIALIZED (SELECT (a.t * {n} + b.t)::INT AS c, (a.s * 8 + b.s)::INT AS s FROM fp a, fp b)"]
    out += [f"x AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, (lat_idx * 8 + lon_idx)::INT AS c, any_value(v) AS v FROM {field} GROUP BY vec_id, lat_idx, lon_idx)", f"t0 AS MATERIALIZED ({b('x')})", "y0 AS (SELECT * FROM t0)"]
    for i in range(1, iterations):
        out += [f"m{i} AS MATERIALIZED ({mean(f't{i - 1}')})", f"g{i} AS MATERIALIZED ({b(f'm{i}')})"]
        out += [f"t{i} AS MATERIALIZED (SELECT vec_id, c, sum(v) AS v FROM (FROM t{i - 1} UNION ALL SELECT vec_id, c, -v FROM g{i}) GROUP BY vec_id, c)"]
        out += [f"y{i} AS MATERIALIZED (SELECT vec_id, c, sum(v) AS v FROM (FROM y{i - 1} UNION ALL FROM t{i}) GROUP BY vec_id, c)"]
    y = f"y{iterations - 1}"
    out += [f"ay AS MATERIALIZED ({mean(y)})", "rest AS MATERIALIZED (SELECT vec_id, c, sum(v) AS v FROM (SELECT vec_id, c, v FROM x UNION ALL SELECT vec_id, c, -v FROM ay) GROUP BY vec_id, c)"]
    out += ["back AS MATERIALIZED (SELECT vec_id, f2p.c, v FROM rest JOIN f2p ON f2p.s = rest.c)"]
    out += [f"rs AS MATERIALIZED (SELECT r.vec_id, l.label, (r.c // {n})::INT AS lat_idx, (r.c % {n})::INT AS lon_idx, r.v FROM (SELECT vec_id, c, sum(v) AS v FROM (FROM {y} UNION ALL FROM back) GROUP BY vec_id, c) r JOIN (SELECT DISTINCT vec_id, label FROM x) l USING (vec_id))"]
    return ", ".join(out)


def _resample_query(name: str, step: float, n: int, iterations: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return resample(_field(spark, d), Resampler(GRID, GRID.refined(step), iterations), BATCH, ["v"]).select(*BATCH, "lat_idx", "lon_idx", _num("v"))

    run.__name__ = name
    query(f"WITH {_EMB}, {_resampled(step, n, iterations)} SELECT vec_id, label, lat_idx, lon_idx, round(v, 6) + 0.0::DOUBLE AS v FROM rs")(run)


_resample_query("resample_refine", 5, 15, 1)
_resample_query("resample_refine_it3", 5, 15, 3)
_resample_query("resample_coarsen", 20, 4, 1)


@query("SELECT vec_id, label, (i // 8)::INT AS lat_idx, (i % 8)::INT AS lon_idx, round(embedding[i + 1]::DOUBLE, 6) AS v FROM embeddings, (SELECT unnest(range(64)) AS i)")
def resample_mean_check(spark: SparkSession, d: str) -> DataFrame:
    """The means of the refined cells are the coarse cells again."""
    fine = resample(_field(spark, d), Resampler(GRID, GRID.refined(5), 2), BATCH, ["v"])
    up = spark.createDataFrame(g.nearest(GRID.lats, g.target_axis(GRID.lats, 5)), "t int, s int")
    lat, lon = up.toDF("lat_idx", "y"), up.toDF("lon_idx", "x")
    out = fine.join(F.broadcast(lat), "lat_idx").join(F.broadcast(lon), "lon_idx").groupBy(*BATCH, "y", "x").agg(F.avg("v").alias("v"))
    return out.select(*BATCH, F.col("y").alias("lat_idx"), F.col("x").alias("lon_idx"), _num("v"))


@query(f"WITH {_EMB}, {_resampled(5, 15)} SELECT vec_id, label, lat_idx, lon_idx, round(v, 6) + 0.0::DOUBLE AS v FROM rs")
def resample_by_matrix(spark: SparkSession, d: str) -> DataFrame:
    rs = Resampler(GRID, GRID.refined(5))
    return apply_matrix(_field(spark, d), matrix(spark, rs), rs, GRID, BATCH, ["v"]).select(*BATCH, "lat_idx", "lon_idx", _num("v"))


@query(f"WITH {_EMB}, {_resampled(5, 15)}, {_TRI}, {_cover(5, 15)} {_zonal('rs')}")
def reduce_refined_two_step(spark: SparkSession, d: str) -> DataFrame:
    return r.reduce_field(_field(spark, d), _triangles(spark, d), GRID, BATCH, ["v"], resolution=5).select(*BATCH, "geom_key", _num("v"))


def _store(spark: SparkSession) -> OperatorStore:
    return OperatorStore(spark, f"{shared_dir(spark)}/operators")


@query(f"WITH {_EMB}, {_resampled(5, 15, 2)}, {_TRI}, {_cover(5, 15)} {_zonal('rs')}")
def reduce_refined_fused(spark: SparkSession, d: str) -> DataFrame:
    """Stencil and operator are built once and read from the store from then on."""
    store, edges, fine = _store(spark), _triangles(spark, d), GRID.refined(5)
    stencil = store.stencil(fine, edges)
    op = store.operator(stencil, stencil_digest(fine, edges), GRID, 2)
    return r.reduce_with_operator(_field(spark, d), op, stencil.row_sums(), BATCH, ["v"], grid=GRID, source=GRID).select(*BATCH, "geom_key", _num("v"))


def _gap(spark: SparkSession, d: str) -> DataFrame:
    """A null cell in every tenth slice, and a missing one in every tenth other."""
    cell = F.col("lat_idx") * 8 + F.col("lon_idx")
    field = _field(spark, d).filter(~((F.col("vec_id") % 10 == 5) & (cell == 27)))
    return field.withColumn("v", F.when(~((F.col("vec_id") % 10 == 0) & (cell == 9)), F.col("v")))


_GAP = "emb_g AS (SELECT vec_id, label, lat_idx, lon_idx, CASE WHEN (vec_id % 10 = 0 AND lat_idx * 8 + lon_idx = 9) OR (vec_id % 10 = 5 AND lat_idx * 8 + lon_idx = 27) THEN NULL ELSE v END AS v FROM emb)"


@query(f"WITH {_EMB}, {_GAP}, {_TRI}, {_cover()} SELECT vec_id, label, geom_key, CASE WHEN count(v) = count(*) THEN round(sum(w * v) / sum(w), 6) + 0.0::DOUBLE END AS v FROM emb_g JOIN w USING (lat_idx, lon_idx) GROUP BY vec_id, label, geom_key")
def operator_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A polygon with a null or missing cell has no value under an operator."""
    stencil = Stencil.build(_triangles(spark, d), GRID)
    return r.reduce_with_operator(_gap(spark, d), r.operator(stencil, GRID), stencil.row_sums(), BATCH, ["v"], grid=GRID, source=GRID).select(*BATCH, "geom_key", _num("v"))


_NAN_GAP = "emb_n AS (SELECT vec_id, label, lat_idx, lon_idx, coalesce(v, 'NaN'::DOUBLE) AS v FROM emb_g)"


@query(f"WITH {_EMB}, {_GAP}, {_NAN_GAP}, {_resampled(5, 15, field='emb_n')} SELECT vec_id, label, lat_idx, lon_idx, CASE WHEN NOT isnan(v) THEN round(v, 6) + 0.0::DOUBLE END AS v FROM rs")
def matrix_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    rs = Resampler(GRID, GRID.refined(5))
    return apply_matrix(_gap(spark, d), _store(spark).resampler(rs), rs, GRID, BATCH, ["v"]).select(*BATCH, "lat_idx", "lon_idx", _num("v"))


@query(f"WITH {_EMB}, {_resampled(5, 15)} SELECT vec_id AS t, label AS w, lat_idx, lon_idx, round(v, 6) + 0.0::DOUBLE AS s FROM rs")
def resample_clashing_names(spark: SparkSession, d: str) -> DataFrame:
    """Batch and value columns named as factors might be."""
    field = _field(spark, d).withColumnsRenamed({"vec_id": "t", "label": "w", "v": "s"})
    return resample(field, Resampler(GRID, GRID.refined(5)), ["t", "w"], ["s"]).select("t", "w", "lat_idx", "lon_idx", _num("s"))


@query(f"WITH {_EMB}, {_resampled(5, 15, 2)}, {_TRI}, {_cover(5, 15)} {_zonal('rs')}")
def reduce_stencil_other_grid(spark: SparkSession, d: str) -> DataFrame:
    """A stencil on a finer grid than the field's, from the store."""
    return r.reduce_with_stencil(_field(spark, d), _store(spark).stencil(GRID.refined(5), _triangles(spark, d)), BATCH, ["v"], grid=GRID, iterations=2).select(*BATCH, "geom_key", _num("v"))


@query(f"WITH {_EMB}, emb_n AS (SELECT vec_id, label, lat_idx, lon_idx, CASE WHEN (lat_idx * 8 + lon_idx + vec_id) % 10 < 3 THEN 'NaN'::DOUBLE ELSE v END AS v FROM emb), {_resampled(5, 15, field='emb_n')}, rn AS (SELECT vec_id, label, lat_idx, lon_idx, CASE WHEN NOT isnan(v) THEN v END AS v FROM rs), {_TRI}, {_cover(5, 15)} {_zonal('rn')}")
def reduce_refined_masked(spark: SparkSession, d: str) -> DataFrame:
    return r.reduce_field(_masked(spark, d), _triangles(spark, d), GRID, BATCH, ["v"], resolution=5).select(*BATCH, "geom_key", _num("v"))


# --- hierarchies ---

_EDGES = """e AS (SELECT n_name AS child, r_name AS parent, count(*)::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name
  UNION ALL SELECT r_name, 'WORLD', 1.0::DOUBLE FROM region)"""


def _tree(how: str, weight: str = "weight") -> str:
    scale = f"{weight} / sum({weight}) OVER (PARTITION BY parent)" if how == "mean" else weight
    return f"""RECURSIVE {_EDGES}, s AS (SELECT child, parent, {scale} AS w FROM e), t(node, leaf, weight, depth) AS (
      SELECT child, child, 1.0::DOUBLE, 0 FROM s WHERE child NOT IN (SELECT parent FROM s)
      UNION ALL SELECT s.parent, t.leaf, t.weight * s.w, t.depth + 1 FROM t JOIN s ON s.child = t.node)"""


def _tree_query(name: str, how: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return tr.Tree.build(_tree_edges(spark, d), how).rows.select("node", "leaf", F.round("weight", 9).alias("weight"), "depth")

    run.__name__ = name
    query(f"WITH {_tree(how)} SELECT node, leaf, round(weight, 9) AS weight, depth::INT AS depth FROM t")(run)


_tree_query("tree_weights_mean", "mean")
_tree_query("tree_weights_sum", "sum")


@query(f"WITH {_tree('mean')} SELECT node, max(depth)::INT AS depth, count(*)::BIGINT AS n_leaves FROM t GROUP BY node")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tr.Tree.build(_tree_edges(spark, d)).rows.groupBy("node").agg(F.max("depth").alias("depth"), F.count("*").alias("n_leaves"))


_LEAVES = "lv AS (SELECT c_mktsegment AS segment, n_name AS geom_key, n_nationkey, n_regionkey, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def _rolled(how: str, weight: str, value: str = "v") -> str:
    x = f"sum(t.weight * {value}) / sum(CASE WHEN {value} IS NOT NULL THEN t.weight END)" if how == "mean" else f"coalesce(sum(t.weight * {value}), 0)"
    return f"WITH {_tree(how, weight)}, {_LEAVES} SELECT segment, node, round({x}, 6) AS v FROM lv JOIN t ON t.leaf = geom_key GROUP BY segment, node"


def _rollup_query(name: str, how: str, weighted: bool, gaps: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        leaves = _leaves(spark, d)
        if gaps:
            leaves = fields.masked(leaves, (F.col("n_nationkey") % 4 == 0) | (F.col("n_regionkey") == 0))
        return tr.aggregate(leaves, tr.Tree.build(_tree_edges(spark, d), how, weighted), ["segment"], ["v"]).select("segment", "node", _num("v"))

    run.__name__ = name
    query(_rolled(how, "weight" if weighted else "1.0::DOUBLE", "CASE WHEN n_nationkey % 4 <> 0 AND n_regionkey <> 0 THEN v END" if gaps else "v"))(run)


_rollup_query("rollup_mean", "mean", False)
_rollup_query("rollup_weighted", "mean", True)
_rollup_query("rollup_sum", "sum", True)
_rollup_query("rollup_nan", "mean", True, True)
_rollup_query("rollup_nan_sum", "sum", False, True)


@query("SELECT n_name AS leaf FROM nation WHERE n_regionkey = 1")
def leaf_missing_check(spark: SparkSession, d: str) -> DataFrame:
    return tr.missing_leaves(_leaves(spark, d).filter("n_regionkey <> 1"), tr.Tree.build(_tree_edges(spark, d)))


@query(f"WITH {_LEAVES}, t AS (SELECT segment, geom_key AS nation, v FROM lv UNION ALL SELECT segment, 'ALL', avg(v) FROM lv GROUP BY segment) SELECT segment, nation, round(v, 6) AS v FROM t")
def rollup_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two levels, (segment, nation) below (segment, 'ALL'), rolled up in one call."""
    own = F.struct(F.col("segment").alias("a"), F.col("geom_key").alias("b"))
    leaves = _leaves(spark, d).select(own.alias("key"), "v")
    edges = leaves.select(F.col("key").alias("child"), F.struct(F.col("key.a").alias("a"), F.lit("ALL").alias("b")).alias("parent"))
    return tr.levels(tr.roll_up(leaves, edges, [], ["v"], weighted=False, key="key"), "key", ["segment", "nation"]).select("segment", "nation", _num("v"))


@query(f"WITH {_LEAVES}, n AS (SELECT * FROM lv JOIN region ON n_regionkey = r_regionkey), per AS (SELECT r_name, geom_key, avg(v) AS v FROM n GROUP BY ALL) SELECT r_name || '/' || geom_key || '/' || segment AS node, round(v, 6) AS v FROM n UNION ALL SELECT r_name || '/' || geom_key, round(v, 6) FROM per UNION ALL SELECT r_name, round(avg(v), 6) FROM per GROUP BY r_name")
def region_style_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Keys with a level less at every step up."""
    regions = _read(spark, d, "region").select("r_regionkey", "r_name")
    leaves = _leaves(spark, d).join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("r_name", "geom_key", "segment").alias("key"), "v")  # five regions
    up = lambda c: F.slice(c, 1, F.size(c) - 1)
    low = leaves.select(F.col("key").alias("child"), up(F.col("key")).alias("parent"))
    edges = low.unionByName(low.select(F.col("parent").alias("child"), up(F.col("parent")).alias("parent")).distinct())
    return tr.roll_up(leaves, edges, [], ["v"], weighted=False, key="key").select(F.array_join("key", "/").alias("node"), _num("v"))


@query(f"WITH {_tree('mean')}, o AS (SELECT node, max(depth) AS depth FROM t GROUP BY node) SELECT node, depth::INT AS depth, (row_number() OVER (ORDER BY depth, node) - 1)::BIGINT AS position FROM o")
def tree_node_order(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark).tree(_tree_edges(spark, d)).nodes()


# --- the rest ---


@query(f"WITH {_EMB}, {_MASKED} SELECT label, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS fraction FROM emb_m GROUP BY label")
def mask_fraction(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d).groupBy("label").agg(F.round(F.avg(F.when(g.valid(F.col("v")), 0.0).otherwise(1.0)), 9).alias("fraction"))


@query("SELECT vec_id, label, list_sum(embedding::DOUBLE[])::DOUBLE IS NOT NULL AS whole, len(embedding)::INT AS n FROM embeddings")
def field_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A field packed again is the array it came from."""
    old = _read(spark, d, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").cast("array<double>").alias("old"))
    new = fields.packed(_field(spark, d), BATCH, 8)
    return new.join(old, F.col("vec_id") == F.col("_id")).select("vec_id", "label", (F.col("v") == F.col("old")).alias("whole"), F.size("v").alias("n"))


@query(f"WITH {_TRI}, {_cover()} SELECT geom_key, (lat_idx * 8 + lon_idx)::BIGINT AS cell_id, round(w / 1e12, 9) AS weight FROM w")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A stencil built once, and read from the store the second time."""
    store, edges = _store(spark), _triangles(spark, d)
    store.stencil(GRID, edges, force=True)
    again = store.get_or_build("stencil", stencil_digest(GRID, edges), lambda: spark.createDataFrame([], "geom_key string"))
    return again.select("geom_key", "cell_id", F.round(F.col("weight") / 1e12, 9).alias("weight"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS v FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 = 0 GROUP BY event_type")
def messages_selected(spark: SparkSession, d: str) -> DataFrame:
    """Messages by the values of their index: those of two types, of every third user."""
    e = _read(spark, d, "events")
    found = fields.selected(e.withColumn("third", F.col("user_id") % 3), event_type=["click", "view"], third=0)
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("v"))
