"""Body templates per nation: straight columns with a closed form, and points, cells and audits on them."""

from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions import address as ad
from bodygrid.functions import points as pt
from bodygrid.operators import body as bd
from bodygrid.operators import tolerance as tl
from bodygrid.plans import q_points as qp
from bodygrid.plans import tables as T
from bodygrid.plans.q_names import stored, text
from bodygrid.plans.registry import ctes, query

N = len(fr.CANONICAL_LEVELS)


def slabs(spark, sf):
    """One template per nation: a straight column down the z axis, round cross-section."""
    n = T.table(spark, sf, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    d = n.select(k.alias("template_id"), F.posexplode(F.array(*[F.lit(x) for x in fr.CANONICAL_LEVELS])).alias("pos", "label"))
    h = (10 + F.col("template_id") % 5).cast("double")
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    return d.select(
        "template_id",
        "pos",
        "label",
        F.array(F.lit(0.0), F.lit(0.0), -(F.col("pos") * h + h / 2)).alias("origin"),
        v(0, 0, -1).alias("axial"),
        v(0, 1, 0).alias("anterior"),
        h.alias("height_mm"),
        F.array_repeat((100 + F.col("template_id")).cast("double"), 8).alias("radii"),
    )


@stored("body_levels")
def levels(spark, sf):
    return bd.spine_levels(slabs(spark, sf))


@stored("body_geometry")
def geometry(spark, sf):
    return bd.geometry(levels(spark, sf))


def body_points(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("point_id"),
        (k % 25).alias("template_id"),
        ((k * 7919 % 23003) / 100.0 - 115.0037).alias("x"),
        ((c * 6007 + k * 31) % 22391 / 100.0 - 112.0071).alias("y"),
        (20.0013 - (k * 104729 + c * 17) % 45007 / 100.0).alias("z"),
    )


BODY = f"""bp AS (SELECT o_orderkey AS point_id, o_orderkey % 25 AS template_id, (o_orderkey * 7919 % 23003) / 100.0::DOUBLE - 115.0037 AS x, ((o_custkey * 6007 + o_orderkey * 31) % 22391) / 100.0::DOUBLE - 112.0071 AS y,
  20.0013::DOUBLE - ((o_orderkey * 104729 + o_custkey * 17) % 45007) / 100.0::DOUBLE AS z FROM orders),
b1 AS (SELECT *, (10 + template_id % 5)::DOUBLE AS h, (100 + template_id)::DOUBLE AS rad, CASE WHEN z > 0 THEN 0 WHEN -z >= {N} * (10 + template_id % 5) THEN {N - 1} ELSE CAST(floor(-z / (10 + template_id % 5)) AS INT) END AS i FROM bp),
b2 AS (SELECT *, CASE WHEN z > 0 THEN 0.0 WHEN -z >= {N} * h THEN 1 - 1e-12::DOUBLE ELSE (-z - i * h) / h END AS u, CASE WHEN atan2(x, y) < 0 THEN atan2(x, y) / 6.283185307179586 + 1 ELSE atan2(x, y) / 6.283185307179586 END AS t, sqrt(x * x + y * y) / rad AS r0 FROM b1),
b3 AS (SELECT *, CASE WHEN r0 > 1 THEN 1 - 1e-12::DOUBLE ELSE r0 END AS r, CAST(floor(t * 12 + 0.5) AS INT) % 12 AS s, z > 0 OR -z >= {N} * h OR r0 > 1 AS clamped FROM b2),
b4 AS (SELECT *, CASE WHEN s = 0 AND t > 0.5 THEN t - 1 ELSE t END - (s / 12.0::DOUBLE - 1 / 24.0::DOUBLE) AS dt FROM b3),
enc AS (SELECT *, {T.LEVELS_SQL}[i + 1] AS level, 'BD-' || {T.LEVELS_SQL}[i + 1] || '-' || lpad(CAST(CASE WHEN s = 0 THEN 12 ELSE s END AS VARCHAR), 2, '0') || CASE WHEN r < 0.5 THEN 'I' ELSE 'O' END || '-' || array_to_string(list_transform(range(1, 5), lambda k:
  CAST(4 * (CAST(floor(u * (1 << k)) AS BIGINT) % 2) + 2 * (CAST(floor(dt * 12 * (1 << k)) AS BIGINT) % 2) + CAST(floor((CASE WHEN r < 0.5 THEN r ELSE r - 0.5 END) * 2 * (1 << k)) AS BIGINT) % 2 AS VARCHAR)), '') AS cell FROM b4)"""


@query(ctes(BODY) + "SELECT point_id, cell, clamped, false AS folded FROM enc")
def encode_body_points(spark, sf):
    """Millimetre points to four-digit body cells in their own template."""
    e = bd.encode_body(body_points(spark, sf), levels(spark, sf), 4)
    return e.select("point_id", text().alias("cell"), "clamped", "folded")


def listed_points(spark, sf):
    """A point per order line: lines of an order are equal rows, and every 26th order names a template nobody has."""
    li = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("point_id"))
    p = body_points(spark, sf).withColumn("template_id", F.col("point_id") % 26)
    return li.join(p, "point_id")


LISTED = BODY.replace("o_orderkey % 25 AS template_id", "o_orderkey % 26 AS template_id").replace("FROM orders)", "FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")


@query(
    ctes(LISTED)
    + """SELECT point_id, CASE WHEN template_id < 25 THEN cell END AS cell, CASE WHEN template_id < 25 THEN clamped END AS clamped,
    CASE WHEN template_id = 25 THEN 'no_template' END AS error_code FROM enc"""
)
def encode_listed_points(spark, sf):
    """Repeated points and unknown templates: every row comes back, with a cell or a reason."""
    e = bd.encode_body(listed_points(spark, sf), levels(spark, sf), 4)
    return e.select("point_id", text().alias("cell"), "clamped", "error_code")


@query(ctes(BODY) + f"SELECT point_id, CASE WHEN z > 0 OR -z >= {N} * h THEN '' ELSE level END AS claiming, CASE WHEN z > 0 OR -z >= {N} * h OR r0 > 1 THEN '' ELSE level END AS addressing FROM enc")
def levels_of_points(spark, sf):
    d = bd.levels_claiming(body_points(spark, sf), levels(spark, sf))
    return d.select("point_id", F.array_join("claiming", ",").alias("claiming"), F.array_join("addressing", ",").alias("addressing"))


@query(
    ctes(BODY)
    + f""", o AS (SELECT point_id, z, h, {T.LEVELS_SQL}[CAST(floor((-z - h / 2) / h) AS INT) + 1] AS level FROM b1)
    SELECT point_id, CASE WHEN -z - h / 2 < 0 THEN 'cranial' WHEN -z - h / 2 >= {N} * h THEN 'caudal' ELSE CASE left(level, 1) WHEN 'C' THEN 'cervical' WHEN 'T' THEN 'thoracic' WHEN 'L' THEN 'lumbar' ELSE 'sacral' END END AS band FROM o"""
)
def body_bands(spark, sf):
    return bd.bands(body_points(spark, sf), slabs(spark, sf)).select("point_id", "band")


LOC = f""", cl AS (SELECT DISTINCT l_suppkey % 25 AS template_id, cell FROM lineitem_cells WHERE cell LIKE 'BD%'),
al AS (SELECT * FROM cl UNION SELECT template_id, replace(cell, 'BD-S05', 'BD-T13') FROM cl UNION SELECT template_id, left(cell, 6) FROM cl),
ix AS (SELECT template_id, cell, list_position({T.LEVELS_SQL}, substr(cell, 4, 3)) - 1 AS i, (10 + template_id % 5)::DOUBLE AS h, (100 + template_id)::DOUBLE AS rad, length(cell) = 6 AS whole, greatest(length(cell) - 11, 0) AS d,
  CAST(CASE WHEN length(cell) = 6 THEN '12' ELSE substr(cell, 8, 2) END AS INT) % 12 AS s, CASE WHEN substr(cell, 10, 1) = 'O' THEN 0.5 ELSE 0 END AS r0, substr(cell, 12) AS dg FROM al),
mm AS (SELECT *, coalesce(list_sum(list_transform(range(1, d + 1), lambda k: CAST(substr(dg, k, 1) AS INT) // 4 * (1 << (d - k)))), 0) AS a, coalesce(list_sum(list_transform(range(1, d + 1), lambda k: CAST(substr(dg, k, 1) AS INT) // 2 % 2 * (1 << (d - k)))), 0) AS b,
  coalesce(list_sum(list_transform(range(1, d + 1), lambda k: CAST(substr(dg, k, 1) AS INT) % 2 * (1 << (d - k)))), 0) AS c, (1 << d)::DOUBLE AS n FROM ix),
lc AS (SELECT *, CASE WHEN whole THEN 0.5 ELSE (a + 0.5) / n END AS u, CASE WHEN whole THEN 0.5 ELSE s / 12.0::DOUBLE - 1 / 24.0::DOUBLE + (b + 0.5) / n / 12 END AS t, CASE WHEN whole THEN 0.5 ELSE r0 + (c + 0.5) / n / 2 END AS r FROM mm)"""


@query(
    ctes(T.LINEITEM_CELLS_SQL) .rstrip()
    + LOC
    + f""" SELECT template_id, cell, CASE WHEN i < {N} THEN round(sin(t * 6.283185307179586) * r * rad, 5) END AS x_mm, CASE WHEN i < {N} THEN round(cos(t * 6.283185307179586) * r * rad, 5) END AS y_mm, CASE WHEN i < {N} THEN round(-(i + u) * h, 5) END AS z_mm,
      CASE WHEN i < {N} THEN round(h / CASE WHEN whole THEN 1 ELSE n END, 5) END AS extent_axial, CASE WHEN i < {N} THEN round(6.283185307179586 * rad * r / CASE WHEN whole THEN 1 ELSE n * 12 END, 5) END AS extent_arc, CASE WHEN i < {N} THEN 'exact' ELSE 'variant' END AS homology, d > 3 AS over_precise, CASE WHEN i < {N} THEN false END AS folded FROM lc"""
)
def locate_body_cells(spark, sf):
    """Body cells of each template to millimetres; a level it lacks has none."""
    r = lambda c: (F.round(c, 5) + 0.0).alias(c)
    d = bd.locate_body(body_cells(spark, sf), geometry(spark, sf), 3)
    return d.select("template_id", text().alias("cell"), r("x_mm"), r("y_mm"), r("z_mm"), r("extent_axial"), r("extent_arc"), "homology", "over_precise", "folded")


def body_cells(spark, sf):
    c = T.lineitem_cells(spark, sf).filter(F.startswith("cell", F.lit("BD"))).select((F.col("l_suppkey") % 25).alias("template_id"), "cell").distinct()
    more = F.array(F.col("cell"), F.replace("cell", F.lit("BD-S05"), F.lit("BD-T13")), F.substring("cell", 1, 6))
    c = c.select("template_id", F.explode(more).alias("cell")).distinct()
    return ad.with_key(c).drop("cell")


@query(ctes(T.LINEITEM_CELLS_SQL).rstrip() + LOC + f" SELECT template_id, cell, CASE WHEN i < {N} THEN left(cell, 6) END AS coarsest FROM lc")
def coarsest_placeable(spark, sf):
    d = bd.coarsest_resolvable(body_cells(spark, sf), geometry(spark, sf))
    return d.select("template_id", text().alias("cell"), text("coarsest").alias("coarsest"))


@query(
    "SELECT n_nationkey AS template_id, unnest(" + T.LEVELS_SQL + f"[1:{N}]) AS label, 240 * 9 AS probed, 0 AS ambiguous, 0 AS unclaimed, 0 AS lost FROM nation"
)
def fold_scan(spark, sf):
    """A straight column never folds; every skin sample is claimed by its own level."""
    return bd.scan_folds(levels(spark, sf))


@query(
    "SELECT n_nationkey AS template_id, unnest(" + T.LEVELS_SQL + f"[1:{N}]) AS label, (100 + n_nationkey)::DOUBLE AS max_radius_mm, 0.0 AS utilisation, true AS admissible, true AS worst_case_admissible FROM nation"
)
def margin_audit(spark, sf):
    return bd.audit_margins(levels(spark, sf)).select("template_id", "label", "max_radius_mm", "utilisation", "admissible", "worst_case_admissible")


def samples(spark, sf):
    e = T.table(spark, sf, "events").select("event_id")
    k = F.col("event_id")
    lv = F.element_at(F.array(*[F.lit(x) for x in fr.CANONICAL_LEVELS]), (k % N + 1).cast("int"))
    return e.select((k % 25).alias("template_id"), lv.alias("label"), ((k * 37 % 997 + 0.5) / 998).alias("su"), ((k * 53 % 991 + 0.25) / 992).alias("st"), ((k * 71 % 983 + 1) / 985).alias("sr"))


@query(f"SELECT event_id % 25 AS template_id, {T.LEVELS_SQL}[CAST(event_id % {N} + 1 AS INT)] AS label, count(*) AS samples, 0 AS failures FROM events GROUP BY ALL")
def round_trips(spark, sf):
    return bd.round_trip(samples(spark, sf), levels(spark, sf)).select("template_id", "label", "samples", "failures")


@query("SELECT n_nationkey AS template_id, true AS preconditions, true AS audit, true AS probe, true AS folds, true AS accepted FROM nation WHERE n_nationkey IN (SELECT event_id % 25 FROM events)")
def template_acceptance(spark, sf):
    lv = levels(spark, sf)
    return bd.accept_templates(slabs(spark, sf), bd.scan_folds(lv, 24), bd.audit_margins(lv, 72), bd.round_trip(samples(spark, sf), lv))


@query(
    f"""WITH e AS (SELECT n_nationkey AS t, (10 + n_nationkey % 5)::DOUBLE AS len, unnest(range({N})) AS i FROM nation), m AS (SELECT t, len, (1 + (i * 7 + t) % {N}) * 0.07 AS edge, row_number() OVER (PARTITION BY t ORDER BY (1 + (i * 7 + t) % {N}) * 0.07) AS r FROM e)
    SELECT t AS template_id, CAST(greatest(0, least(12, floor(log2(len / edge)))) AS INT) AS digits FROM m WHERE r = {N} // 2 + 1"""
)
def template_digits(spark, sf):
    """Digits a mesh's edge length justifies."""
    d = levels(spark, sf).select("template_id", "len", ((1 + (F.col("pos") * 7 + F.col("template_id")) % N) * 0.07).alias("edge_mm"))
    return bd.useful_digits(d)


# ---- same place ---------------------------------------------------------------------


def brain_subjects(spark, sf):
    """Brain templates of different size, one per region of the world."""
    r = T.table(spark, sf, "region").select("r_regionkey")
    k = F.col("r_regionkey")
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    ext = lambda n, b: (b + k * 1.5).cast("double").alias(n)
    return r.select(
        F.concat(F.lit("brain-"), k).alias("id"), k.alias("subject"), v(0, 0, 0).alias("ac"), v(-1, 0, 0).alias("left"), v(0, 1, 0).alias("anterior"), v(0, 0, 1).alias("superior"),
        F.struct(*[ext(n, b) for n, b in (("left", 65), ("right", 65), ("anterior", 68), ("posterior", 100), ("superior", 74), ("inferior", 60))]).alias("extents"),
        F.lit(6).alias("max_useful_digits"),
    )


def brain_cells(spark, sf, table, key, mult):
    c = T.table(spark, sf, table).select(F.col(key).alias("id"))
    k = F.col("id")
    octal = F.lpad(F.conv(((k * mult) % 4096).cast("string"), 10, 8), 4, "0")
    cell = F.concat(F.lit("BV-"), F.when(k % 2 == 0, "L").otherwise("R"), F.lit("-"), F.substring(octal, F.lit(1), 3 + (k % 2).cast("int")))
    d = ad.with_key(c.select("id", (k % 5).alias("subject"), cell.alias("cell")))
    subj = brain_subjects(spark, sf)
    cols = [F.col(n).alias(f"t_{n}") for n in subj.columns if n != "subject"]
    d = d.join(subj.select("subject", *cols), "subject")
    d = pt.locate_brain(d, "cell_key", pt.template_columns("t_"))
    return d.select(
        "id", "cell", "cell_key", F.col("t_id").alias("template_id"), "x_mm", "y_mm", "z_mm",
        F.col("extent_lateral").alias("e0"), F.col("extent_ap").alias("e1"), F.col("extent_si").alias("e2"),
        F.array("t_left", "t_anterior", "t_superior").alias("axes"), F.lit(False).alias("folded"), F.lit(True).alias("placed"),
    )


def _loc_sql(name, table, key, mult):
    return f"""{name}0 AS (SELECT {key} AS id, {key} % 5 AS sj, 'BV-' || CASE WHEN {key} % 2 = 0 THEN 'L' ELSE 'R' END || '-' || left(lpad(to_base(({key} * {mult}) % 4096, 8), 4, '0'), CAST(3 + {key} % 2 AS INT)) AS cell FROM {table}),
{name}1 AS (SELECT *, length(cell) - 5 AS d, list_sum(list_transform(range(1, length(cell) - 4), lambda k: CAST(substr(cell, 5 + k, 1) AS INT) // 4 * (1 << (length(cell) - 5 - k)))) AS a, list_sum(list_transform(range(1, length(cell) - 4), lambda k: CAST(substr(cell, 5 + k, 1) AS INT) // 2 % 2 * (1 << (length(cell) - 5 - k)))) AS b,
  list_sum(list_transform(range(1, length(cell) - 4), lambda k: CAST(substr(cell, 5 + k, 1) AS INT) % 2 * (1 << (length(cell) - 5 - k)))) AS c, (1 << (length(cell) - 5))::DOUBLE AS n, 1.5 * sj AS g FROM {name}0),
{name} AS (SELECT id, cell, sj, CASE WHEN cell LIKE 'BV-L%' THEN -1 ELSE 1 END * (65 + g) * (a + 0.5) / n AS x, ((b + 0.5) / n - 0.5) * 2 * CASE WHEN (b + 0.5) / n < 0.5 THEN 100 + g ELSE 68 + g END AS y, ((c + 0.5) / n - 0.5) * 2 * CASE WHEN (c + 0.5) / n < 0.5 THEN 60 + g ELSE 74 + g END AS z,
  (65 + g) / n AS ex, 2 * CASE WHEN (b + 0.5) / n < 0.5 THEN 100 + g ELSE 68 + g END / n AS ey, 2 * CASE WHEN (c + 0.5) / n < 0.5 THEN 60 + g ELSE 74 + g END / n AS ez FROM {name}1)"""


PAIR = """, j AS (SELECT p.id AS a_id, q.id AS b_id, p.cell AS ca, q.cell AS cb, p.sj AS sa, q.sj AS sb, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz, p.ex + q.ex AS hx, p.ey + q.ey AS hy, p.ez + q.ez AS hz FROM p, q),
g AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS gap FROM j),
s AS (SELECT *, greatest(0, gap - CASE WHEN gap > 0 THEN (hx * abs(dx) + hy * abs(dy) + hz * abs(dz)) / 2 / gap ELSE 0 END, sqrt(power(greatest(0, abs(dx) - hx / 2), 2) + power(greatest(0, abs(dy) - hy / 2), 2) + power(greatest(0, abs(dz) - hz / 2), 2))) AS sep FROM g)"""


@query(ctes(_loc_sql("p", "supplier", "s_suppkey", 1237), _loc_sql("q", "customer", "c_custkey", 3571)).rstrip() + PAIR + " SELECT a_id, b_id, round(gap, 5) AS gap_mm, round(sep, 5) AS separation_mm FROM s WHERE sep <= 5.0")
def same_place_pairs(spark, sf):
    """Cells of different subjects within five millimetres of each other."""
    j = tl.tolerance_join(brain_cells(spark, sf, "supplier", "s_suppkey", 1237), brain_cells(spark, sf, "customer", "c_custkey", 3571), 5.0)
    return j.select("a_id", "b_id", F.round("gap_mm", 5).alias("gap_mm"), F.round("separation_mm", 5).alias("separation_mm"))


@query(
    ctes(_loc_sql("p", "supplier", "s_suppkey", 1237), _loc_sql("q", "customer", "c_custkey", 3571)).rstrip()
    + PAIR
    + """, cp AS (SELECT s_suppkey AS a, (s_suppkey * 3) % 25 AS b FROM supplier), rk AS (SELECT a_id AS a, b_id % 25 AS b, gap, sep, ca, cb, row_number() OVER (PARTITION BY a_id, b_id % 25 ORDER BY round(gap, 9), ca, cb) AS r FROM s)
    SELECT cp.a, cp.b, coalesce(sep <= 5.0, false) AS same, round(gap, 5) AS gap_mm, round(sep, 5) AS separation_mm FROM cp LEFT JOIN rk ON rk.a = cp.a AND rk.b = cp.b AND r = 1"""
)
def same_place_coverings(spark, sf):
    """Asked pairs of coverings in two subjects, with the closest cells."""
    a = brain_cells(spark, sf, "supplier", "s_suppkey", 1237).withColumn("covering_id", F.col("id")).drop("id")
    b = brain_cells(spark, sf, "customer", "c_custkey", 3571).withColumn("covering_id", F.col("id") % 25)
    b = b.drop("id")
    pairs = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 3 % 25).alias("b"))
    d = tl.coverings_same_place(a, b, pairs, 5.0)
    return d.select("a", "b", "same", F.round("gap_mm", 5).alias("gap_mm"), F.round("separation_mm", 5).alias("separation_mm"))


@query(
    ctes(qp.POINTS_SQL)
    + """, two AS (SELECT x, y, z, x + ((l_partkey % 7) - 3) * 0.5 AS x2, y + ((l_orderkey % 5) - 2) * 0.5 AS y2, z + ((l_suppkey % 3) - 1) * 0.5 AS z2 FROM pts WHERE NOT isnan(z)),
    f AS (SELECT list_transform([[x, y, z], [x2, y2, z2]], lambda p: [CASE WHEN -p[1] >= 0 THEN 0.0 ELSE 1.0 END, least(1 - 1e-12::DOUBLE, abs(-p[1]) / 72.5), least(1 - 1e-12::DOUBLE, greatest(0.0, CASE WHEN p[2] < 0 THEN 0.5 + p[2] / 217.0 ELSE 0.5 + p[2] / 147.0 END)), least(1 - 1e-12::DOUBLE, greatest(0.0, CASE WHEN p[3] < 0 THEN 0.5 + p[3] / 145.0 ELSE 0.5 + p[3] / 165.0 END))]) AS q FROM two),
    d AS (SELECT *, unnest([2, 3, 4, 5]) AS digits FROM f)
    SELECT digits, count(*) AS pairs, round(avg(CASE WHEN q[1][1] = q[2][1] AND floor(q[1][2] * (1 << digits)) = floor(q[2][2] * (1 << digits)) AND floor(q[1][3] * (1 << digits)) = floor(q[2][3] * (1 << digits)) AND floor(q[1][4] * (1 << digits)) = floor(q[2][4] * (1 << digits)) THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM d GROUP BY digits"""
)
def address_survival(spark, sf):
    """Share of observed point pairs whose cells agree, by digit count."""
    p = qp.points(spark, sf).filter("not isnan(z)")
    p = p.withColumns({"x2": F.col("x") + (F.col("l_partkey") % 7 - 3) * 0.5, "y2": F.col("y") + (F.col("l_orderkey") % 5 - 2) * 0.5, "z2": F.col("z") + (F.col("l_suppkey") % 3 - 1) * 0.5})
    p = p.select("x", "y", "z", "x2", "y2", "z2")
    a = pt.encode_brain(p, "x", "y", "z", qp.tpl(), 8).select("x2", "y2", "z2", F.col("cell_key").alias("key_a"))
    b = pt.encode_brain(a, "x2", "y2", "z2", qp.tpl(), 8).select("key_a", F.col("cell_key").alias("key_b"))
    return tl.survival(b, [2, 3, 4, 5]).select("digits", "pairs", F.round("agreement", 9).alias("agreement"))
