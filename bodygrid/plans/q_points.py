"""Millimetre points, sphere directions and geometric regions over the driver tables."""

import math

from pyspark.sql import functions as F

from bodygrid.functions import address as ad
from bodygrid.functions import points as pt
from bodygrid.operators import regions as rg
from bodygrid.plans import tables as T
from bodygrid.plans.registry import ctes, query
from bodygrid.plans.q_names import text, normalize_sql

def tpl():
    return pt.literal_template(pt.ICBM152)

POINTS_SQL = """pts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    ((l_orderkey * 7919 + l_linenumber * 104729) % 15001) / 100.0::DOUBLE - 75.0 AS x, ((l_partkey * 6007 + l_orderkey * 31) % 18401) / 100.0::DOUBLE - 109.0 AS y,
    CASE WHEN (l_suppkey * 499 + l_orderkey) % 997 = 0 THEN 'NaN'::DOUBLE ELSE ((l_suppkey * 4999 + l_orderkey * 13) % 15601) / 100.0::DOUBLE - 73.0 END AS z FROM lineitem)"""
ENC_SQL = """fr AS (SELECT *, abs(-x) / 72.5 AS a0, CASE WHEN y < 0 THEN 0.5::DOUBLE + y / 217.0 ELSE 0.5::DOUBLE + y / 147.0 END AS b0, CASE WHEN z < 0 THEN 0.5::DOUBLE + z / 145.0 ELSE 0.5::DOUBLE + z / 165.0 END AS c0 FROM pts),
un AS (SELECT *, least(1 - 1e-12::DOUBLE, greatest(0.0::DOUBLE, a0)) AS a, least(1 - 1e-12::DOUBLE, greatest(0.0::DOUBLE, b0)) AS b, least(1 - 1e-12::DOUBLE, greatest(0.0::DOUBLE, c0)) AS c FROM fr),
enc AS (SELECT *, isnan(z) AS bad, CASE WHEN isnan(z) THEN NULL ELSE 'BV-' || CASE WHEN -x >= 0 THEN 'L' ELSE 'R' END || '-' || array_to_string(list_transform(range(1, 7), lambda i:
  CAST(4 * (CAST(floor(a * (1 << i)) AS BIGINT) % 2) + 2 * (CAST(floor(b * (1 << i)) AS BIGINT) % 2) + CAST(floor(c * (1 << i)) AS BIGINT) % 2 AS VARCHAR)), '') END AS cell,
  (a0 >= 1 OR b0 < 0 OR b0 >= 1 OR c0 < 0 OR c0 >= 1) AS clamped FROM un)"""


def points(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return li.select(
        "*",
        (((ok * 7919 + ln * 104729) % 15001) / 100.0 - 75.0).alias("x"),
        (((pk * 6007 + ok * 31) % 18401) / 100.0 - 109.0).alias("y"),
        F.when((sk * 499 + ok) % 997 == 0, F.lit(float("nan"))).otherwise(((sk * 4999 + ok * 13) % 15601) / 100.0 - 73.0).alias("z"),
    )


@query(
    ctes(POINTS_SQL, ENC_SQL)
    + "SELECT l_orderkey, l_linenumber, cell, CASE WHEN NOT bad THEN clamped END AS clamped, CASE WHEN bad THEN 'nan_coordinate' END AS error_code FROM enc"
)
def encode_brain_points(spark, sf):
    """Millimetre points to six-digit brain cells with clamp flags; NaN points are refused."""
    e = pt.encode_brain(points(spark, sf), "x", "y", "z", tpl(), 6)
    return e.select("l_orderkey", "l_linenumber", text().alias("cell"), "clamped", "error_code")


@query(
    ctes(POINTS_SQL, ENC_SQL, "q AS (SELECT DISTINCT left(cell, 9) AS cell FROM enc WHERE NOT bad)")
    + """, ix AS (SELECT cell, list_sum(list_transform(range(1, 5), lambda i: CAST(substr(cell, 5 + i, 1) AS INT) // 4 * (1 << (4 - i)))) AS a,
      list_sum(list_transform(range(1, 5), lambda i: (CAST(substr(cell, 5 + i, 1) AS INT) // 2) % 2 * (1 << (4 - i)))) AS b,
      list_sum(list_transform(range(1, 5), lambda i: CAST(substr(cell, 5 + i, 1) AS INT) % 2 * (1 << (4 - i)))) AS c FROM q),
    f AS (SELECT cell, (a + 0.5) / 16 AS fa, (b + 0.5) / 16 AS fb, (c + 0.5) / 16 AS fc FROM ix)
    SELECT cell, round(CASE WHEN cell LIKE 'BV-L%' THEN -72.5 * fa ELSE 72.5 * fa END, 6) AS x_mm,
      round(CASE WHEN fb < 0.5 THEN (fb - 0.5) * 217 ELSE (fb - 0.5) * 147 END, 6) AS y_mm, round(CASE WHEN fc < 0.5 THEN (fc - 0.5) * 145 ELSE (fc - 0.5) * 165 END, 6) AS z_mm,
      round(72.5 / 16, 6) AS extent_lateral, round(CASE WHEN fb < 0.5 THEN 217 ELSE 147 END / 16.0, 6) AS extent_ap, round(CASE WHEN fc < 0.5 THEN 145 ELSE 165 END / 16.0, 6) AS extent_si,
      false AS over_precise FROM f"""
)
def locate_brain_cells(spark, sf):
    e = pt.encode_brain(points(spark, sf), "x", "y", "z", tpl(), 4).filter("cell_key is not null").select("cell_key").distinct()
    r = lambda c: F.round(c, 6).alias(c)
    return pt.locate_brain(e, "cell_key", tpl()).select(
        text().alias("cell"), r("x_mm"), r("y_mm"), r("z_mm"), r("extent_lateral"), r("extent_ap"), r("extent_si"), "over_precise"
    )


@query(
    ctes(POINTS_SQL, ENC_SQL)
    + """, res AS (SELECT DISTINCT cell, (l_suppkey % 40) * 0.5::DOUBLE AS residual FROM enc WHERE NOT bad),
    lv AS (SELECT *, unnest(range(0, 13)) AS d FROM res),
    f AS (SELECT cell, residual, d, least(72.5 / (1 << d), CASE WHEN d = 0 THEN 182.0 WHEN CAST(substr(cell, 6, 1) AS INT) // 2 % 2 = 1 THEN 147.0 / (1 << d) ELSE 217.0 / (1 << d) END,
      CASE WHEN d = 0 THEN 155.0 WHEN CAST(substr(cell, 6, 1) AS INT) % 2 = 1 THEN 165.0 / (1 << d) ELSE 145.0 / (1 << d) END) AS small FROM lv),
    b AS (SELECT cell, residual, min(d) FILTER (d > 6 OR small < residual) AS fd FROM f GROUP BY cell, residual)
    SELECT cell, residual, CAST(greatest(fd - 1, 0) AS INT) AS digits, CASE WHEN fd > 6 THEN 'template' WHEN fd = 0 THEN 'frame' ELSE 'residual' END AS limited_by FROM b"""
)
def recommended_precision(spark, sf):
    """Digits each cell supports for a stated residual and which ceiling binds."""
    e = pt.encode_brain(points(spark, sf), "x", "y", "z", tpl(), 6).filter("cell_key is not null")
    q = e.select("cell_key", ((F.col("l_suppkey") % 40) * 0.5).alias("residual")).distinct()
    r = pt.recommended_digits(q, F.col("residual"), tpl())
    return r.select(text().alias("cell"), "residual", "digits", "limited_by")


@query(
    ctes(POINTS_SQL, ENC_SQL, "cells AS (SELECT DISTINCT l_suppkey AS covering_id, left(cell, 8) AS cell FROM enc WHERE NOT bad)", normalize_sql("cells", "covering_id", "nc"))
    + "SELECT covering_id, cell FROM nc"
)
def point_coverings(spark, sf):
    """All points of each supplier as one three-digit covering."""
    cells, _ = rg.covering_from_points(points(spark, sf), "l_suppkey", "x", "y", "z", tpl(), 3)
    return cells.select(F.col("l_suppkey").alias("covering_id"), text().alias("cell"))


@query(
    ctes(POINTS_SQL, ENC_SQL)
    + """, nt AS (SELECT l_suppkey AS covering_id, bad, clamped, concat_ws('; ', CASE WHEN a0 >= 1 THEN 'lateral fraction fell outside the template bounding box' END,
      CASE WHEN b0 < 0 OR b0 >= 1 THEN 'anterior-posterior fraction fell outside the template bounding box' END, CASE WHEN c0 < 0 OR c0 >= 1 THEN 'superior-inferior fraction fell outside the template bounding box' END) AS note FROM enc)
    SELECT covering_id, count(*) FILTER (clamped AND NOT bad) AS clamped_points, count(*) FILTER (bad) AS refused_points,
      coalesce(string_agg(DISTINCT note, ' | ' ORDER BY note) FILTER (note <> '' AND NOT bad), '') AS notes FROM nt GROUP BY covering_id"""
)
def point_covering_report(spark, sf):
    _, report = rg.covering_from_points(points(spark, sf), "l_suppkey", "x", "y", "z", tpl(), 1)
    return report.withColumnRenamed("l_suppkey", "covering_id")


def balls(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("region_id"),
        ((k * 37 % 101) - 50.0).alias("cx"),
        ((k * 53 % 121) - 60.0).alias("cy"),
        ((k * 71 % 111) - 50.0).alias("cz"),
        (8.0 + k % 23).alias("radius"),
    )


# A ball's covering by definition: every cell whose class is inside with all coarser cells partial, or partial at the last digit.
def _cells_sql(d: int) -> str:
    n = 1 << d
    return f"""c{d} AS (SELECT s.h, {d} AS d, x.a, x.b, x.c FROM (SELECT unnest([1, -1]) AS h) s, (SELECT unnest(range({n})) AS a) a_, LATERAL (SELECT a_.a, b_.b, c_.c FROM (SELECT unnest(range({n})) AS b) b_, (SELECT unnest(range({n})) AS c) c_) x)"""


BALL_SQL = ctes(*[_cells_sql(d) for d in range(4)]) + """, ball AS (SELECT s_suppkey AS region_id, (s_suppkey * 37 % 101) - 50.0::DOUBLE AS cx, (s_suppkey * 53 % 121) - 60.0::DOUBLE AS cy, (s_suppkey * 71 % 111) - 50.0::DOUBLE AS cz, 8.0::DOUBLE + s_suppkey % 23 AS radius FROM supplier),
allc AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
g AS (SELECT *, (1 << d)::DOUBLE AS n FROM allc),
m AS (SELECT h, d, a, b, c, -72.5 * h * (a + 0.5::DOUBLE) / n AS x, ((b + 0.5::DOUBLE) / n - 0.5) * CASE WHEN (b + 0.5::DOUBLE) / n < 0.5 THEN 217 ELSE 147 END AS y, ((c + 0.5::DOUBLE) / n - 0.5) * CASE WHEN (c + 0.5::DOUBLE) / n < 0.5 THEN 145 ELSE 165 END AS z,
  sqrt(power(72.5 / n, 2) + power(CASE WHEN d = 0 THEN 182 WHEN (b + 0.5::DOUBLE) / n < 0.5 THEN 217 / n ELSE 147 / n END, 2) + power(CASE WHEN d = 0 THEN 155 WHEN (c + 0.5::DOUBLE) / n < 0.5 THEN 145 / n ELSE 165 / n END, 2)) / 2 AS reach FROM g),
cls AS (SELECT region_id, h, d, a, b, c, CASE WHEN sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2)) + reach <= radius THEN 'inside'
  WHEN sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2)) - reach >= radius THEN 'outside' ELSE 'partial' END AS side FROM m, ball),
reach AS (SELECT k.*, NOT EXISTS (SELECT 1 FROM cls p WHERE p.region_id = k.region_id AND p.h = k.h AND p.d < k.d AND p.a = k.a >> (k.d - p.d) AND p.b = k.b >> (k.d - p.d) AND p.c = k.c >> (k.d - p.d) AND p.side <> 'partial') AS open FROM cls k),
cells AS (SELECT region_id, 'BV-' || CASE WHEN h = 1 THEN 'L' ELSE 'R' END || CASE WHEN d = 0 THEN '' ELSE '-' END || array_to_string(list_transform(range(1, d + 1), lambda i: CAST(4 * ((a >> (d - i)) % 2) + 2 * ((b >> (d - i)) % 2) + (c >> (d - i)) % 2 AS VARCHAR)), '') AS cell
  FROM reach WHERE open AND (side = 'inside' OR (side = 'partial' AND d = 3))),
""" + normalize_sql("cells", "region_id", "bc") + " SELECT region_id, cell FROM bc"


@query(BALL_SQL)
def ball_coverings(spark, sf):
    """One ball per supplier covered by subdivision to three digits, partial cells included."""
    return rg.covering_from_balls(balls(spark, sf), "region_id", tpl(), 3).select("region_id", text().alias("cell"))


@query(
    "SELECT DISTINCT 'tpl-' || n_regionkey AS template_id, 'BD-' || " + T.LEVELS_SQL + "[CAST(n_nationkey + 1 AS INT)] AS cell FROM nation"
)
def body_template_roots(spark, sf):
    n = T.table(spark, sf, "nation")
    lv = F.element_at(T._levels(), (F.col("n_nationkey") + 1).cast("int"))
    return rg.body_roots(n.select(F.concat(F.lit("tpl-"), "n_regionkey").alias("template_id"), lv.alias("label")))


# ---- sphere ---------------------------------------------------------------------

DIR_SQL = """dirs AS (SELECT event_id, acos(2.0::DOUBLE * ((event_id * 7919) % 9973) / 9973 - 1) AS theta, 6.283185307179586 * ((event_id * 104729 + user_id) % 99991) / 99991.0::DOUBLE AS phi FROM events)"""


def directions(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "user_id")
    k = F.col("event_id")
    return e.select(
        "event_id",
        F.acos(2.0 * ((k * 7919) % 9973) / 9973 - 1).alias("theta"),
        (6.283185307179586 * ((k * 104729 + F.col("user_id")) % 99991) / 99991.0).alias("phi"),
    )


# Independent route: the pixel found by walking the two diagonal line families face by face.
HPX_SQL = DIR_SQL + """, hz AS (SELECT event_id, cos(theta) AS z, phi / 1.5707963267948966 AS tt FROM dirs),
hx AS (SELECT event_id, z, tt, CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN NULL ELSE least(3, CAST(floor(tt) AS BIGINT)) END AS n, 16 * sqrt(3 * (1 - abs(z))) AS tmp,
  CAST(floor(16 * (0.5 + tt) - 16 * z * 0.75) AS BIGINT) AS jp, CAST(floor(16 * (0.5 + tt) + 16 * z * 0.75) AS BIGINT) AS jm FROM hz),
hf AS (SELECT event_id, CASE WHEN n IS NULL THEN CASE WHEN jp // 16 = jm // 16 THEN (jp // 16) % 4 + 4 WHEN jp // 16 < jm // 16 THEN (jp // 16) % 4 ELSE (jm // 16) % 4 + 8 END WHEN z >= 0 THEN n ELSE n + 8 END AS face,
  CASE WHEN n IS NULL THEN jm % 16 WHEN z >= 0 THEN 15 - least(15, CAST(floor((1 - (tt - n)) * tmp) AS BIGINT)) ELSE least(15, CAST(floor((tt - n) * tmp) AS BIGINT)) END AS ix,
  CASE WHEN n IS NULL THEN 15 - jp % 16 WHEN z >= 0 THEN 15 - least(15, CAST(floor((tt - n) * tmp) AS BIGINT)) ELSE least(15, CAST(floor((1 - (tt - n)) * tmp) AS BIGINT)) END AS iy FROM hx),
px AS (SELECT event_id, face * 256 + list_sum(list_transform(range(0, 4), lambda i: ((ix >> i) % 2) * (1 << (2 * i)) + ((iy >> i) % 2) * (1 << (2 * i + 1)))) AS pix FROM hf)"""


@query("WITH " + HPX_SQL + " SELECT event_id, CAST(pix AS BIGINT) AS pix, CAST(pix // 4 AS BIGINT) AS parent_pix, 'BR-L-' || to_base(CAST(pix // 256 AS BIGINT), 16) || lpad(to_base(CAST(pix % 256 AS BIGINT), 16), 2, '0') AS cell FROM px")
def sphere_binning(spark, sf):
    """Directions to nested equal-area pixels at order 4, the parent pixel and the cell text."""
    p = pt.sphere_pixel(directions(spark, sf), "theta", "phi", 4)
    return p.select(
        "event_id",
        "pix",
        F.call_function("shiftright", F.col("pix"), F.lit(2)).alias("parent_pix"),
        ad.cell_text(pt.sphere_cell_key(F.col("pix"), 4, F.lit("L"))).alias("cell"),
    )


@query("WITH " + HPX_SQL + f" SELECT CAST(pix AS BIGINT) AS pix, count(*) AS n, round({math.pi} / 3 / 256, 9) AS solid_angle, true AS centre_in_pixel FROM px GROUP BY pix")
def sphere_density(spark, sf):
    """Counts per pixel; each pixel's centre direction must fall back into the pixel."""
    p = pt.sphere_pixel(directions(spark, sf), "theta", "phi", 4).groupBy("pix").agg(F.count(F.lit(1)).alias("n"))
    c = pt.sphere_centre(p, "pix", 4)
    back = pt.sphere_pixel(c, "theta_centre", "phi_centre", 4, "back")
    return back.select("pix", "n", F.round(F.lit(math.pi / 3 / 256), 9).alias("solid_angle"), (F.col("back") == F.col("pix")).alias("centre_in_pixel"))


@query(
    """SELECT event_id, value, CAST(CASE WHEN CAST(floor((value / 100 - floor(value / 100)) * 12 + 0.5) AS INT) % 12 = 0 THEN 12 ELSE CAST(floor((value / 100 - floor(value / 100)) * 12 + 0.5) AS INT) % 12 END AS INT) AS clock FROM events"""
)
def azimuth_sectors(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "value")
    return e.withColumn("clock", pt.turn_to_clock(F.col("value") / 100))


MNI = [[0.0011, 0.00002, -0.00003, 0.0007], [-0.00001, 0.0009, 0.00012, 1.62], [0.00004, -0.0001, 0.00105, 0.021]]


@query(
    ctes(POINTS_SQL)
    + "SELECT l_orderkey, l_linenumber, round(0.0011 * x + 0.00002 * y + -0.00003 * z + 0.0007, 9) AS wx, round(-0.00001 * x + 0.0009 * y + 0.00012 * z + 1.62, 9) AS wy, "
    + "round(0.00004 * x + -0.0001 * y + 0.00105 * z + 0.021, 9) AS wz, round(x, 4) AS bx, round(y, 4) AS by, round(z, 4) AS bz FROM pts WHERE NOT isnan(z)"
)
def affine_there_and_back(spark, sf):
    """Points through a registration matrix and its inverse."""
    p = points(spark, sf).filter(~F.isnan("z"))
    w = pt.apply_affine(MNI, F.col("x"), F.col("y"), F.col("z"))
    p = p.select("l_orderkey", "l_linenumber", w[0].alias("wx"), w[1].alias("wy"), w[2].alias("wz"))
    b = pt.apply_affine(pt.invert_affine(MNI), F.col("wx"), F.col("wy"), F.col("wz"))
    return p.select(
        "l_orderkey",
        "l_linenumber",
        *[F.round(c, 9).alias(c) for c in ("wx", "wy", "wz")],
        *[F.round(e, 4).alias(n) for e, n in zip(b, ("bx", "by", "bz"))],
    )
