"""Triangle and voxel tables derived from suppliers, parts, lineitem and embeddings."""

from pyspark.sql import functions as F

from bodygrid.operators import mesh as ms
from bodygrid.plans import tables as T
from bodygrid.plans.q_names import stored
from bodygrid.plans.registry import ctes, query

# The twelve outward triangles of a unit box over corner numbers x + 2y + 4z.
BOX = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def boxes(spark, sf):
    """One box per supplier; every tenth lacks a face, repeats a point in a triangle, or has a stray vertex."""
    s = T.table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("mesh_id"),
        (k * 37 % 101 - 50).cast("double").alias("x0"),
        (k * 53 % 121 - 60).cast("double").alias("y0"),
        (k * 71 % 111 - 50).cast("double").alias("z0"),
        (4 + k % 7).cast("double").alias("sx"),
        (5 + k % 11).cast("double").alias("sy"),
        (6 + k % 5).cast("double").alias("sz"),
    )


BOXES = """box AS (SELECT s_suppkey AS mesh_id, (s_suppkey * 37 % 101 - 50)::DOUBLE AS x0, (s_suppkey * 53 % 121 - 60)::DOUBLE AS y0, (s_suppkey * 71 % 111 - 50)::DOUBLE AS z0,
  (4 + s_suppkey % 7)::DOUBLE AS sx, (5 + s_suppkey % 11)::DOUBLE AS sy, (6 + s_suppkey % 5)::DOUBLE AS sz FROM supplier)"""


def vertices(spark, sf):
    b = boxes(spark, sf).withColumn("vid", F.explode(F.sequence(F.lit(0), F.when(F.col("mesh_id") % 10 == 5, 8).otherwise(7))))
    bit = lambda i: F.call_function("shiftright", "vid", F.lit(i)).bitwiseAND(F.lit(1))
    stray = F.col("vid") == 8
    at = lambda o, s, i: F.when(stray, F.col(o) - 100).otherwise(F.col(o) + F.col(s) * bit(i))
    return b.select("mesh_id", "vid", at("x0", "sx", 0).alias("x"), at("y0", "sy", 1).alias("y"), at("z0", "sz", 2).alias("z"))


def triangles(spark, sf):
    rows = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, (a, b, c) in enumerate(BOX)])
    t = boxes(spark, sf).select("mesh_id", F.inline(rows))
    t = t.filter(~((F.col("mesh_id") % 10 == 3) & (F.col("tid") >= 10)))
    extra = boxes(spark, sf).filter("mesh_id % 10 = 4").select("mesh_id", F.lit(12).alias("tid"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c"))
    return t.unionByName(extra)


def solid(spark, sf):
    """Vertices, the triangles of closed surfaces, and why the others are not."""
    return vertices(spark, sf), *ms.solids(triangles(spark, sf))


def surfaces(spark, sf):
    return vertices(spark, sf), triangles(spark, sf)


def soup(spark, sf):
    """The same boxes as unwelded triangle soup: every corner its own vertex."""
    v, t = vertices(spark, sf), triangles(spark, sf)
    e = t.select("mesh_id", "tid", F.posexplode(F.array("a", "b", "c")).alias("i", "vid")).join(v, ["mesh_id", "vid"])
    sv = e.select("mesh_id", (F.col("tid") * 3 + F.col("i")).alias("vid"), "x", "y", "z")
    st = t.select("mesh_id", "tid", *[(F.col("tid") * 3 + i).alias(n) for i, n in enumerate("abc")])
    return sv, st


@query(
    "WITH " + BOXES
    + " SELECT mesh_id, 8 AS vertices, CASE WHEN mesh_id % 10 = 3 THEN 10 ELSE 12 END AS triangles FROM box"
)
def welded_meshes(spark, sf):
    v, t = ms.weld(*soup(spark, sf))
    n = v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"))
    return n.join(t.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("triangles")), "mesh_id")


@query(
    "WITH " + BOXES
    + """ SELECT mesh_id, round(2 * (sx * sy + sy * sz + sx * sz) - CASE WHEN mesh_id % 10 = 3 THEN sy * sz ELSE 0 END, 6) AS area, CASE mesh_id % 10 WHEN 3 THEN 10 WHEN 4 THEN 13 ELSE 12 END AS triangles,
      CASE WHEN mesh_id % 10 = 4 THEN 1 ELSE 0 END AS degenerate, CASE WHEN mesh_id % 10 = 5 THEN 1 ELSE 0 END AS unused, x0 AS drawn_lo_x, y0 + sy AS drawn_hi_y, CASE WHEN mesh_id % 10 = 5 THEN z0 - 100 ELSE z0 END AS lo_z FROM box"""
)
def mesh_statistics(spark, sf):
    s = ms.surface_stats(vertices(spark, sf), triangles(spark, sf))
    return s.select("mesh_id", F.round("area", 6).alias("area"), "triangles", "degenerate", "unused", "drawn_lo_x", "drawn_hi_y", "lo_z")


@query(
    "WITH " + BOXES
    + """ SELECT mesh_id, round(sx * sy * sz, 6) AS volume, round(x0 + sx / 2, 6) AS centroid_x, round(y0 + sy / 2, 6) AS centroid_y, round(z0 + sz / 2, 6) AS centroid_z,
      round(x0 + sx / 2, 6) AS area_centroid_x, 0.0 AS open_share, NULL AS reason FROM box WHERE mesh_id % 10 <> 3
      UNION ALL SELECT mesh_id, NULL, NULL, NULL, NULL, NULL, NULL, 'open' FROM box WHERE mesh_id % 10 = 3"""
)
def mesh_volumes(spark, sf):
    """Measures of closed surfaces, and a reason for the others."""
    v, t, why = solid(spark, sf)
    r = lambda c: F.round(c, 6).alias(c)
    s = ms.volumes(v, t).select("mesh_id", r("volume"), r("centroid_x"), r("centroid_y"), r("centroid_z"), r("area_centroid_x"), "open_share")
    return s.unionByName(why, allowMissingColumns=True)


@query(
    "WITH " + BOXES
    + " SELECT mesh_id, CASE mesh_id % 10 WHEN 4 THEN 19 WHEN 3 THEN 17 ELSE 18 END AS edges, CASE mesh_id % 10 WHEN 3 THEN 4 WHEN 4 THEN 1 ELSE 0 END AS open_edges, CASE WHEN mesh_id % 10 = 4 THEN 1 ELSE 0 END AS over_shared, 0 AS inconsistent FROM box"
)
def mesh_edges(spark, sf):
    return ms.edge_report(triangles(spark, sf))


@query(
    "WITH " + BOXES
    + """, c AS (SELECT mesh_id, unnest(range(8)) AS vid FROM box), n AS (SELECT mesh_id, vid, CASE WHEN vid % 2 = 1 THEN 1 ELSE -1 END AS ux, CASE WHEN vid // 2 % 2 = 1 THEN 1 ELSE -1 END AS uy, CASE WHEN vid // 4 = 1 THEN 1 ELSE -1 END AS uz FROM c)
    SELECT mesh_id, vid, CASE WHEN mesh_id % 10 = 3 AND ux = 1 THEN 0 ELSE ux END AS sign_x, uy AS sign_y, uz AS sign_z, 1.0 AS length FROM n
    UNION ALL SELECT mesh_id, 8, 0, 0, 1, 1.0 FROM box WHERE mesh_id % 10 = 5"""
)
def mesh_normals(spark, sf):
    n = ms.vertex_normals(*surfaces(spark, sf))
    sg = lambda a: F.signum(f"n{a}").cast("int").alias(f"sign_{a}")
    return n.select("mesh_id", "vid", sg("x"), sg("y"), sg("z"), F.round(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), 6).alias("length"))


# ---- many parts in one mesh -----------------------------------------------------------


def strips(spark, sf):
    """One mesh per nation: a strip of triangles per part of its suppliers' parts, of the part's size."""
    p = T.table(spark, sf, "part").select("p_partkey", "p_size")
    i = F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("i")
    t = p.select((F.col("p_partkey") % 25).alias("mesh_id"), "p_partkey", i)
    base = F.col("p_partkey") * 100 + F.col("i")
    return t.select("mesh_id", (base).alias("tid"), base.alias("a"), (base + 1).alias("b"), (base + 2).alias("c"))


@query(
    "SELECT p_partkey % 25 AS mesh_id, p_partkey * 100 AS component, p_size AS triangles, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_size DESC, p_partkey) AS rank FROM part"
)
def mesh_components(spark, sf):
    """Connected components ranked by size; each part's strip is one component."""
    return ms.ranked_components(strips(spark, sf))


@query(
    """WITH t AS (SELECT p_partkey % 25 AS mesh_id, p_partkey * 100 + i AS tid, p_partkey AS k, i FROM part, LATERAL (SELECT unnest(range(p_size)) AS i)),
    l AS (SELECT *, CASE WHEN (k * 100 + i) // 7 % 4 < 3 THEN 'p' || (k * 100 + i) // 7 % 4 END AS la, CASE WHEN (k * 100 + i + 1) // 7 % 4 < 3 THEN 'p' || (k * 100 + i + 1) // 7 % 4 END AS lb, CASE WHEN (k * 100 + i + 2) // 7 % 4 < 3 THEN 'p' || (k * 100 + i + 2) // 7 % 4 END AS lc FROM t)
    SELECT mesh_id, tid, CASE WHEN lb IS NOT DISTINCT FROM lc THEN lb ELSE la END AS label FROM l"""
)
def labelled_surfaces(spark, sf):
    """Triangles split by their corners' majority label."""
    t = strips(spark, sf)
    v = t.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    n = F.floor(F.col("vid") / 7) % 4
    labels = v.filter(n < 3).select("mesh_id", "vid", F.concat(F.lit("p"), n).alias("label"))
    return ms.split_by_label(v, labels, t)


# ---- points and solids --------------------------------------------------------------------

PTS = """ip AS (SELECT DISTINCT l_orderkey * 1000003 + l_partkey AS point_id, ((l_orderkey * 7919) % 11003) / 100.0::DOUBLE - 52.003 AS x, ((l_partkey * 6007 + l_orderkey) % 13007) / 100.0::DOUBLE - 61.007 AS y, ((l_orderkey * 13 + l_partkey * 4999) % 12007) / 100.0::DOUBLE - 51.009 AS z FROM lineitem)"""


def inner_points(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    return li.select(
        (ok * 1000003 + pk).alias("point_id"),
        (((ok * 7919) % 11003) / 100.0 - 52.003).alias("x"),
        (((pk * 6007 + ok) % 13007) / 100.0 - 61.007).alias("y"),
        (((ok * 13 + pk * 4999) % 12007) / 100.0 - 51.009).alias("z"),
    ).distinct()


INSIDE = "x > x0 AND x < x0 + sx AND y > y0 AND y < y0 + sy AND z > z0 AND z < z0 + sz"


@stored("inside_points")
def inside(spark, sf):
    v, t, _ = solid(spark, sf)
    return ms.points_in_solids(inner_points(spark, sf), v, t, 4.0)


@query(ctes(BOXES, PTS) + f"SELECT point_id, mesh_id, NULL AS reason FROM ip JOIN box ON mesh_id % 10 <> 3 AND {INSIDE} UNION ALL SELECT NULL, mesh_id, 'open' FROM box WHERE mesh_id % 10 = 3")
def points_in_solids(spark, sf):
    """Point in closed surface by parity of three skew rays; surfaces that aren't closed with the reason."""
    return inside(spark, sf).select("point_id", "mesh_id").unionByName(solid(spark, sf)[2], allowMissingColumns=True)


DIST = """sqrt(power(greatest(x0 - x, x - x0 - sx, 0), 2) + power(greatest(y0 - y, y - y0 - sy, 0), 2) + power(greatest(z0 - z, z - z0 - sz, 0), 2))"""
DEPTH = "CASE WHEN " + INSIDE + " THEN least(x - x0, x0 + sx - x, y - y0, y0 + sy - y, z - z0, z0 + sz - z) ELSE " + DIST + " END"


def supplier_points(spark, sf):
    s = T.table(spark, sf, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return s.select(k.alias("point_id"), ((k * 7919 % 11003) / 100.0 - 52.003).alias("x"), ((k * 6007 % 13007) / 100.0 - 61.007).alias("y"), ((k * 4999 % 12007) / 100.0 - 51.009).alias("z"))


_D = {ax: f"power(greatest({ax}0 - {ax}, {ax} - {ax}0 - s{ax}, 0), 2)" for ax in "xyz"}
_FACE = lambda ax, at: f"sqrt(power({ax} - {at}, 2) + {' + '.join(d for o, d in _D.items() if o != ax)})"
#: Distance to the faces of a box; one in ten has none at its far end along x.
SURFACE = "least(" + ", ".join([_FACE(ax, f"{ax}0") for ax in "xyz"] + [_FACE(ax, f"({ax}0 + s{ax})") for ax in "yz"] + [f"CASE WHEN mesh_id % 10 <> 3 THEN {_FACE('x', '(x0 + sx)')} END"]) + ")"

CP = """cpt AS (SELECT c_custkey AS point_id, (c_custkey * 7919 % 11003) / 100.0::DOUBLE - 52.003 AS x, (c_custkey * 6007 % 13007) / 100.0::DOUBLE - 61.007 AS y, (c_custkey * 4999 % 12007) / 100.0::DOUBLE - 51.009 AS z FROM customer)"""


@query(ctes(BOXES, CP) + f"SELECT point_id, round(min({SURFACE}), 6) AS distance FROM cpt, box GROUP BY point_id")
def nearest_surfaces(spark, sf):
    """Exact distance to the nearest triangle, inside or outside."""
    v, t = surfaces(spark, sf)
    n = ms.nearest_surface(supplier_points(spark, sf), v, t, 4.0)
    return n.select("point_id", F.round("distance", 6).alias("distance"))


@query(
    ctes(BOXES, PTS)
    + f""", d AS (SELECT point_id, mesh_id, {DEPTH} AS depth FROM ip JOIN box ON mesh_id % 10 <> 3 AND {INSIDE}) SELECT mesh_id, count(*) AS inside, count(*) FILTER (depth > 1) AS deeper_than_1, count(*) FILTER (depth > 2) AS deeper_than_2 FROM d GROUP BY mesh_id"""
)
def depth_inside_solids(spark, sf):
    v, t = surfaces(spark, sf)
    p = inside(spark, sf).join(inner_points(spark, sf), "point_id").withColumn("pid", F.concat_ws("/", "point_id", "mesh_id"))
    d = ms.nearest_surface(p.select(F.col("pid").alias("point_id"), "mesh_id", "x", "y", "z"), v, t, 4.0, by=["mesh_id"])
    d = d.withColumn("point_id", F.substring_index("point_id", "/", 1).cast("long"))
    return ms.depth_report(p, inside(spark, sf), d, [1.0, 2.0])[0]


RAYS_SQL = """ry AS (SELECT n_nationkey AS ray_id, -80.0::DOUBLE AS ox, (n_nationkey * 5 - 60)::DOUBLE + 0.37 AS oy, (n_nationkey * 4 - 48)::DOUBLE + 0.41 AS oz FROM nation)"""


def rays(spark, sf):
    n = T.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    z = F.lit(0.0)
    return n.select(k.alias("ray_id"), F.lit(-80.0).alias("ox"), ((k * 5 - 60).cast("double") + 0.37).alias("oy"), ((k * 4 - 48).cast("double") + 0.41).alias("oz"), F.lit(1.0).alias("dx"), z.alias("dy"), z.alias("dz"))


@query(ctes(BOXES, RAYS_SQL) + "SELECT ray_id, mesh_id, round(x0 - ox, 6) AS t, row_number() OVER (PARTITION BY ray_id ORDER BY x0 - ox, mesh_id) AS rank FROM ry JOIN box ON oy > y0 AND oy < y0 + sy AND oz > z0 AND oz < z0 + sz")
def ray_picks(spark, sf):
    """Every solid each ray hits, nearest first."""
    v, t = surfaces(spark, sf)
    return ms.pick(rays(spark, sf), v, t, 8.0, 200.0).select("ray_id", "mesh_id", F.round("t", 6).alias("t"), "rank")


@query("WITH " + BOXES + ", m AS (SELECT mesh_id, (mesh_id % 4 + 1) * 0.25 AS mm FROM box) SELECT mesh_id, mm AS max_mm, mm AS mean_mm, mm AS p95_mm, mm AS hausdorff_mm FROM m")
def surface_deviations(spark, sf):
    """A surface against a copy made longer along x at both ends, by another length for each mesh."""
    v, t = surfaces(spark, sf)
    v, mm = ms.drawn(v, t), (F.col("mesh_id") % 4 + 1) * 0.25
    moved = v.withColumn("x", F.when(F.col("vid") % 2 == 1, F.col("x") + mm).otherwise(F.col("x") - mm))
    pts = lambda d: d.select(F.concat_ws("/", "mesh_id", "vid").alias("point_id"), "mesh_id", "x", "y", "z")
    a = ms.one_sided_distance(pts(v), moved, t, 2.0)
    b = ms.one_sided_distance(pts(moved), v, t, 2.0)
    d = ms.surface_deviation(a, b)
    r = lambda c: F.round(c, 6).alias(c)
    return b.select("mesh_id", r("max_mm"), r("mean_mm"), r("p95_mm")).join(d.select("mesh_id", r("hausdorff_mm")), "mesh_id")


@query("WITH " + BOXES + """, m AS (SELECT mesh_id, CASE WHEN mesh_id % 10 = 5 THEN (8 * (x0 + sx / 2) + x0 - 100) / 9 ELSE x0 + sx / 2 END AS mean FROM box)
    SELECT mesh_id, round(mean, 6) AS mean_x FROM m WHERE sign(mean) <> CASE WHEN mesh_id % 2 = 0 THEN 1 ELSE -1 END""")
def laterality_check(spark, sf):
    w = boxes(spark, sf).select("mesh_id", F.when(F.col("mesh_id") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    return ms.laterality(vertices(spark, sf), w).select("mesh_id", F.round("mean_x", 6).alias("mean_x"))


@query(
    "WITH " + BOXES
    + """ SELECT 'ids_differ' AS rule, CAST(mesh_id AS VARCHAR) AS row_id FROM box WHERE mesh_id % 7 = 1 UNION ALL SELECT 'axis_share', CAST(mesh_id AS VARCHAR) FROM box WHERE mesh_id % 7 = 2
    UNION ALL SELECT 'area_ratio', CAST(mesh_id AS VARCHAR) FROM box, (VALUES (1), (2)) f(faces) WHERE faces = CASE WHEN mesh_id % 10 = 3 THEN 1 ELSE 2 END AND mesh_id % 7 = 2 AND (0.8 * sx * sy + 0.8 * sx * sz + faces * sy * sz) / (2 * sx * sy + 2 * sx * sz + faces * sy * sz) < 0.75
    UNION ALL SELECT 'published_differs', CAST(mesh_id AS VARCHAR) FROM box WHERE mesh_id % 7 = 3"""
)
def tier_quality(spark, sf):
    """A reduced tier against the full one, with a missing, a squeezed and a misreported mesh."""
    v, t = surfaces(spark, sf)
    full = ms.surface_stats(v, t)
    k = F.col("mesh_id") % 7
    x0 = boxes(spark, sf).select("mesh_id", "x0")
    sv = v.join(x0, "mesh_id").withColumn("x", F.when(k == 2, F.col("x0") + (F.col("x") - F.col("x0")) * 0.4).otherwise(F.col("x"))).drop("x0")
    tier = ms.surface_stats(sv.filter(k != 1), t.filter(k != 1))
    pub = tier.select("mesh_id", F.when(k == 3, F.col("area") + 1).otherwise(F.col("area")).alias("published_area"))
    return ms.tier_problems(full, tier, pub).select("rule", "row_id")


@query("WITH " + BOXES + " SELECT mesh_id, round(sqrt(0.25 + power((mesh_id % 4) * 0.5, 2)), 6) AS off_mm, NULL AS reason FROM box WHERE mesh_id % 10 <> 3 AND mesh_id % 4 >= 2 UNION ALL SELECT mesh_id, NULL, 'open' FROM box WHERE mesh_id % 10 = 3")
def anchor_points(spark, sf):
    v, t, why = solid(spark, sf)
    c = ms.volumes(v, t)
    rec = boxes(spark, sf).select("mesh_id", (F.col("x0") + F.col("sx") / 2 + 0.5).alias("rx"), (F.col("y0") + F.col("sy") / 2 + (F.col("mesh_id") % 4) * 0.5).alias("ry"), (F.col("z0") + F.col("sz") / 2).alias("rz"))
    return ms.anchor_problems(c, rec).select("mesh_id", F.round("off_mm", 6).alias("off_mm")).unionByName(why, allowMissingColumns=True)


_CORNERS = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(BOX))
_AT = lambda p, ax, bit: f"{ax}0 + s{ax} * ({p} // {bit} % 2)"


@query(
    "WITH " + BOXES
    + f""", tri AS (SELECT mesh_id, tid, {', '.join(f'({_AT("a", ax, n)} + {_AT("b", ax, n)} + {_AT("c", ax, n)}) / 3 AS {ax}' for ax, n in (('x', 1), ('y', 2), ('z', 4)))},
      CASE WHEN tid < 4 THEN sx * sy WHEN tid < 8 THEN sx * sz ELSE sy * sz END AS w FROM box, (VALUES {_CORNERS}) v(tid, a, b, c) WHERE NOT (mesh_id % 10 = 3 AND tid >= 10)),
    m AS (SELECT mesh_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz, sum(w) AS w FROM tri GROUP BY mesh_id),
    c AS (SELECT mesh_id, {', '.join(f'sum(tri.w * ({p} - m{p}) * ({q} - m{q})) / max(m.w) AS {p}{q}' for p, q in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM tri JOIN m USING (mesh_id) GROUP BY mesh_id)
    SELECT mesh_id, round(xx + yy + zz, 4) AS total, round(xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz), 3) AS squares,
      round(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz), 2) AS product, true AS sorted FROM c"""
)
def principal_axis_lengths(spark, sf):
    """Lengths along the principal axes, by their sum, sum of squares and product, which SQL can tell from the matrix."""
    e = ms.principal_axes(*surfaces(spark, sf))
    a, b, c = F.col("e0"), F.col("e1"), F.col("e2")
    return e.select("mesh_id", F.round(a + b + c, 4).alias("total"), F.round(a * a + b * b + c * c, 3).alias("squares"), F.round(a * b * c, 2).alias("product"), ((a >= b) & (b >= c)).alias("sorted"))


# ---- voxels ---------------------------------------------------------------------------------

VOX = """vox AS (SELECT l_suppkey AS volume_id, l_partkey % 17 AS i, l_orderkey % 13 AS j, l_linenumber AS k, max(l_quantity) AS value FROM lineitem GROUP BY ALL)"""


def voxels(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return li.groupBy(F.col("l_suppkey").alias("volume_id"), (F.col("l_partkey") % 17).alias("i"), (F.col("l_orderkey") % 13).alias("j"), F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").alias("value"))


@query("WITH " + VOX + """ SELECT s_suppkey AS volume_id, count(v.value) AS n, min(i) AS lo_i, max(i) AS hi_i, min(j) AS lo_j, max(j) AS hi_j, min(k) AS lo_k, max(k) AS hi_k FROM supplier LEFT JOIN vox v ON v.volume_id = s_suppkey AND value > 49.5 GROUP BY s_suppkey""")
def mask_bounds(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("volume_id"))
    return ms.mask_bounds(voxels(spark, sf), s, 49.5)


@query(
    "WITH " + VOX
    + """, lab AS (SELECT 'L' || volume_id AS label, (i - 8)::DOUBLE AS x, j::DOUBLE AS y, k::DOUBLE AS z, value / 60.0 AS v, volume_id % 6 AS lm FROM vox), per AS (SELECT lm, x, y, z, least(sum(v), 1.0) AS w FROM lab WHERE x <> 0 GROUP BY ALL)
    SELECT 'mark-' || lm AS landmark, CASE WHEN x < 0 THEN 'left' ELSE 'right' END AS side, round(sum(w * x) / sum(w), 6) AS cx, round(sum(w * y) / sum(w), 6) AS cy, round(sum(w * z) / sum(w), 6) AS cz FROM per GROUP BY ALL"""
)
def label_centroids(spark, sf):
    """Probability-weighted centroid per landmark and side."""
    v = voxels(spark, sf)
    lab = v.select(F.concat(F.lit("L"), "volume_id").alias("label"), (F.col("i") - 8).cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("k").cast("double").alias("z"), (F.col("value") / 60.0).alias("value"))
    m = T.table(spark, sf, "supplier").select(F.concat(F.lit("mark-"), F.col("s_suppkey") % 6).alias("landmark"), F.concat(F.lit("L"), "s_suppkey").alias("label"))
    r = lambda c: F.round(c, 6).alias(c)
    return ms.weighted_centroids(lab, m).select("landmark", "side", r("cx"), r("cy"), r("cz"))


@query(
    "WITH " + VOX
    + """, p AS (SELECT o_orderkey AS point_id, o_orderkey % (SELECT count(*) FROM supplier) AS volume_id, (o_custkey % 160) / 10.0::DOUBLE AS x, (o_orderkey % 120) / 10.0::DOUBLE AS y, 1 + (o_custkey % 50) / 10.0::DOUBLE AS z FROM orders),
    c AS (SELECT *, unnest(range(8)) AS o FROM p), q AS (SELECT *, floor(x) + o % 2 AS i, floor(y) + o // 2 % 2 AS j, floor(z) + o // 4 AS k,
      CASE WHEN o % 2 = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN o // 2 % 2 = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN o // 4 = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END AS w FROM c)
    SELECT point_id, round(sum(w * coalesce(value, 0)), 6) AS value FROM q LEFT JOIN vox USING (volume_id, i, j, k) GROUP BY point_id"""
)
def sampled_volumes(spark, sf):
    """Trilinear samples; outside counts as zero."""
    n = T.table(spark, sf, "supplier").select(F.count(F.lit(1))).scalar()
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % n).alias("volume_id"), ((F.col("o_custkey") % 160) / 10.0).alias("x"), ((F.col("o_orderkey") % 120) / 10.0).alias("y"), (1 + (F.col("o_custkey") % 50) / 10.0).alias("z"))
    return ms.trilinear(p, voxels(spark, sf)).select("point_id", F.round("value", 6).alias("value"))


@query(
    "WITH " + BOXES
    + """ SELECT mesh_id AS box_id, CAST((floor((x0 + sx) / 2) - ceil(x0 / 2) + 1) * (floor((y0 + sy) / 2) - ceil(y0 / 2) + 1) * (floor((z0 + sz) / 2) - ceil(z0 / 2) + 1) AS BIGINT) AS n,
      ceil(x0 / 2) * 2 AS first_x, floor((z0 + sz) / 2) * 2 AS last_z FROM box"""
)
def lattice_points(spark, sf):
    b = boxes(spark, sf).select(F.col("mesh_id").alias("box_id"), F.col("x0").alias("lo_x"), (F.col("x0") + F.col("sx")).alias("hi_x"), F.col("y0").alias("lo_y"), (F.col("y0") + F.col("sy")).alias("hi_y"), F.col("z0").alias("lo_z"), (F.col("z0") + F.col("sz")).alias("hi_z"))
    return ms.lattice(b, 2.0).groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("first_x"), F.max("z").alias("last_z"))


# ---- fits -------------------------------------------------------------------------------------


def landmark_pairs(spark, sf):
    """Embedding triples moved by a known map per label."""
    e = T.table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    s = 1 + F.col("label") * 0.1
    return e.select("vec_id", "label", "x", "y", "z", (s * F.col("y") * -1 + 3).alias("tx"), (s * F.col("x") + F.col("label")).alias("ty"), (s * F.col("z") - 2).alias("tz"))


@query("SELECT label, 0.0 AS m00, round(-1 - label * 0.1, 4) AS m01, 3.0 AS m03, round(1 + label * 0.1, 4) AS m10, CAST(label AS DOUBLE) AS m13, round(1 + label * 0.1, 4) AS m22, -2.0 AS m23 FROM embeddings GROUP BY label")
def fitted_affines(spark, sf):
    """Least-squares affine per label from normal-equation sums."""
    f = ms.fit_affine(landmark_pairs(spark, sf), "label")
    return f.select("label", *[(F.round(c, 4) + 0.0).alias(c) for c in ("m00", "m01", "m03", "m10", "m13", "m22", "m23")])


@query("SELECT vec_id, 0.0 AS residual, 0.0 AS loo_residual FROM embeddings")
def affine_residuals(spark, sf):
    p = landmark_pairs(spark, sf)
    r = ms.affine_residuals(p, ms.fit_affine(p, "label"), "label").select("vec_id", F.round("residual", 4).alias("residual"))
    return r.join(ms.leave_one_out(p, "label").select("vec_id", F.round("loo_residual", 4).alias("loo_residual")), "vec_id")


@query("SELECT label, round(1 + label * 0.1, 4) AS scale, -1.0 AS r01, 1.0 AS r10, 1.0 AS r22, 3.0 AS t0, CAST(label AS DOUBLE) AS t1 FROM embeddings GROUP BY label")
def fitted_similarities(spark, sf):
    f = ms.fit_similarity(landmark_pairs(spark, sf), "label")
    return f.select("label", *[F.round(c, 4).alias(c) for c in ("scale", "r01", "r10", "r22", "t0", "t1")])


@query("SELECT label, round(v, 6) AS quantile FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)) WHERE r = floor(n * 0.95) + 1")
def exact_quantiles(spark, sf):
    e = T.table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v"))
    return ms.exact_quantile(e, "label", "v", 0.95).select("label", F.round("quantile", 6).alias("quantile"))


# ---- origin of surfaces -------------------------------------------------------------------------

MOVED = f"""src AS (SELECT s_suppkey AS of, CASE WHEN s_suppkey % 9 = 8 THEN s_suppkey - 1 ELSE s_suppkey END AS mesh_id, s_suppkey % 6 * 0.9 + 0.05 AS mv FROM supplier),
cb AS (SELECT of, x0 + mv AS x0, y0 + 0.137 AS y0, z0 + 0.291 AS z0, sx, sy, sz, mesh_id AS from_id FROM src JOIN box USING (mesh_id)),
cv AS (SELECT of, i, x0 + sx * (i % 2) AS x, y0 + sy * (i // 2 % 2) AS y, z0 + sz * (i // 4) AS z FROM cb, (SELECT unnest(range(8)) AS i)),
rv AS (SELECT mesh_id AS ref, i, x0 + sx * (i % 2) AS x, y0 + sy * (i // 2 % 2) AS y, z0 + sz * (i // 4) AS z FROM box, (SELECT unnest(range(8)) AS i)),
ctl AS (SELECT c.of, arg_min(b.mesh_id, power(c.x0 + c.sx / 2 - b.x0 - b.sx / 2, 2) + power(c.y0 + c.sy / 2 - b.y0 - b.sy / 2, 2) + power(c.z0 + c.sz / 2 - b.z0 - b.sz / 2, 2)) AS ref FROM cb c JOIN box b ON b.mesh_id <> c.of GROUP BY c.of),
prs AS (SELECT of, of AS ref, 'own' AS role FROM cb UNION ALL SELECT of, ref, 'other' FROM ctl),
fw AS (SELECT prs.of, role, {SURFACE} AS d FROM prs JOIN cv ON cv.of = prs.of JOIN box ON box.mesh_id = prs.ref),
fs AS (SELECT of, role, sum(d) AS s, count(*) AS n, list(d ORDER BY d)[CAST(floor(count(*) * 0.95) + 1 AS INT)] AS p95 FROM fw GROUP BY ALL),
bk AS (SELECT prs.of, role, {SURFACE.replace("mesh_id", "from_id")} AS d FROM prs JOIN rv ON rv.ref = prs.ref JOIN cb ON cb.of = prs.of),
bs AS (SELECT of, role, sum(d) AS s, count(*) AS n FROM bk GROUP BY ALL),
nr AS (SELECT of, i, arg_min(mesh_id, {SURFACE}) AS ref FROM cv, box GROUP BY ALL), lb AS (SELECT of, ref, count(*) AS hits FROM nr GROUP BY ALL),
sc AS (SELECT prs.of, prs.ref, prs.role, (fs.s + bs.s) / (fs.n + bs.n) AS mean, p95, coalesce(hits, 0) / fs.n AS agreement FROM prs JOIN fs USING (of, role) JOIN bs USING (of, role) LEFT JOIN lb ON lb.of = prs.of AND lb.ref = prs.ref)"""


@query(
    ctes(BOXES, MOVED)
    + """SELECT o.of AS name, c.ref AS against, round(o.mean, 6) AS own_mean, round(o.p95, 6) AS own_p95, round(o.agreement, 6) AS own_agreement, round(c.mean, 6) AS other_mean, round(c.p95, 6) AS other_p95, round(c.agreement, 6) AS other_agreement,
      o.mean <= 1.5 AND o.p95 <= 3 AND o.agreement >= 0.9 AS matched, c.mean <= 1.5 AND c.p95 <= 3 AND c.agreement >= 0.9 AS control_passes FROM sc o JOIN sc c ON o.of = c.of AND o.role = 'own' AND c.role = 'other'"""
)
def origin_matches(spark, sf):
    """Moved surfaces against references by name and, as control, against the nearest other; one in nine is really its neighbour."""
    rv, rt = surfaces(spark, sf)
    k = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("of"))
    src = k.select("of", F.when(F.col("of") % 9 == 8, F.col("of") - 1).otherwise(F.col("of")).alias("mesh_id"))
    t = rt.join(src, "mesh_id").drop("mesh_id").withColumnRenamed("of", "mesh_id")
    v = rv.join(src, "mesh_id").select(F.col("of").alias("mesh_id"), "vid", (F.col("x") + F.col("of") % 6 * 0.9 + 0.05).alias("x"), (F.col("y") + 0.137).alias("y"), (F.col("z") + 0.291).alias("z"))
    s = ms.origin_verdict(ms.origin_scores(v, t, rv, rt, 4.0))
    figures = [F.round(f"{r}_{n}", 6).alias(f"{r}_{n}") for r in ("own", "other") for n in ("mean", "p95", "agreement")]
    return s.select(F.col("mesh_id").alias("name"), "against", *figures, "matched", "control_passes")
