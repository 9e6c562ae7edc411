import math
import tempfile

from pyspark.sql import functions as F

from bodygrid.functions import address as ad
from bodygrid.functions import points as pt
from bodygrid.functions import titles as tt
from bodygrid.operators import body as bd
from bodygrid.operators import catalogue as ca
from bodygrid.operators import checks as ck
from bodygrid.operators import tolerance as tl
from bodygrid.streaming import run_available


def bent(spark, turn, radius):
    """A column of four levels, each turned by ``turn`` from the one above in the y/z plane."""
    rows, y, z = [], 0.0, 0.0
    for i, label in enumerate(("T01", "T02", "T03", "T04")):
        a = i * turn
        dy, dz = math.sin(a), -math.cos(a)
        rows.append(("t", i, label, [0.0, y + 10 * dy, z + 10 * dz], [0.0, dy, dz], [0.0, math.cos(a), math.sin(a)], 20.0, [radius] * 12))
        y, z = y + 20 * dy, z + 20 * dz
    return spark.createDataFrame(rows, "template_id string, pos int, label string, origin array<double>, axial array<double>, anterior array<double>, height_mm double, radii array<double>")


def grid(levels):
    u = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]))
    d = levels.select("template_id", "label", u.alias("su")).withColumn("st", F.explode(F.array(*[F.lit(x / 16 + 0.01) for x in range(16)])))
    return d.withColumn("sr", F.explode(F.array(F.lit(0.3), F.lit(0.95))))


def test_gently_bent_column_round_trips_and_a_sharp_one_folds(spark):
    lv = bd.spine_levels(bent(spark, 0.1, 60.0)).cache()
    trips = bd.round_trip(grid(lv), lv)
    assert trips.agg(F.sum("failures")).first()[0] == 0
    assert bd.audit_margins(lv, 72).filter("not admissible").count() == 0
    sharp = bd.spine_levels(bent(spark, 0.5, 60.0)).cache()
    assert bd.audit_margins(sharp, 72).filter("not admissible").count() > 0
    assert bd.scan_folds(sharp, 24).agg(F.sum(F.col("ambiguous") + F.col("unclaimed") + F.col("lost"))).first()[0] > 0
    assert bd.round_trip(grid(sharp), sharp).agg(F.sum("failures")).first()[0] > 0


def test_body_encode_then_locate(spark):
    lv = bd.spine_levels(bent(spark, 0.1, 60.0))
    p = spark.createDataFrame([(1, "t", 5.1, 7.2, -11.3), (1, "t", 5.1, 7.2, -11.3), (2, "t", 1.0, 2.0, 50.0), (3, "t", 500.0, 0.1, -30.0), (4, "t", float("nan"), 0.0, 0.0)], "id int, template_id string, x double, y double, z double")
    rows = bd.encode_body(p, lv, 3).collect()
    assert len(rows) == 5  # equal input rows are kept
    by = {r["id"]: r for r in rows}
    assert not by[1]["clamped"] and by[2]["clamped"] and by[3]["clamped"]
    assert by[4]["cell_key"] is None and by[4]["error_code"] == "nan_coordinate"
    key = by[1]["cell_key"]
    loc = bd.locate_body(spark.createDataFrame([("t", key)], "template_id string, cell_key long"), bd.geometry(lv), 3).first()
    assert loc["homology"] == "exact" and math.dist((loc["x_mm"], loc["y_mm"], loc["z_mm"]), (5.1, 7.2, -11.3)) < 12


def test_brain_midline_clamp_and_nan(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, -72.5, 0.0, 0.0), (3, float("inf"), 0.0, 0.0), (4, 0.0, float("nan"), 0.0)], "id int, x double, y double, z double")
    e = pt.encode_brain(p, "x", "y", "z", pt.literal_template(pt.ICBM152), 2).withColumn("cell", ad.cell_text(F.col("cell_key")))
    r = {x["id"]: x for x in e.collect()}
    assert r[1]["cell"] == "BV-L-30" and not r[1]["clamped"]
    assert r[2]["clamped"] and r[3]["clamped"] and r[3]["cell"].startswith("BV-R-7")
    assert r[4]["cell"] is None and r[4]["error_code"] == "nan_coordinate"


def test_disjoint_cells_are_never_the_same_place_at_zero(spark):
    d = ad.with_key(spark.createDataFrame([("a", "BV-L-4"), ("b", "BV-L-5"), ("c", "BV-L-47")], "id string, cell string"))
    t = pt.literal_template(pt.ICBM152)
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    l = pt.locate_brain(d, "cell_key", t).select(
        "id", "cell_key", F.lit("t").alias("template_id"), "x_mm", "y_mm", "z_mm", F.col("extent_lateral").alias("e0"), F.col("extent_ap").alias("e1"), F.col("extent_si").alias("e2"),
        F.array(v(-1, 0, 0), v(0, 1, 0), v(0, 0, 1)).alias("axes"), F.lit(False).alias("folded"), F.lit(True).alias("placed"),
    )
    at0 = {(r["a_id"], r["b_id"]) for r in tl.tolerance_join(l, l, 0.0).collect()}
    assert ("a", "c") in at0 and ("a", "b") not in at0
    assert ("a", "b") in {(r["a_id"], r["b_id"]) for r in tl.tolerance_join(l, l, 0.001).collect()}


def test_title_folding(spark):
    d = spark.createDataFrame([("<i>The Brain's Default Network</i>", "The Brain’s default network"), ("20years", "20 years"), ("Großhirnrinde", "Grosshirnrinde"), ("Æsir ø ﬁ", "aesir o fi")], "a string, b string")
    f = tt.fold(d, {"x": F.col("a"), "y": F.col("b")})
    assert f.filter("x <> y").count() == 0
    n = spark.createDataFrame([("Van Essen DC",), ("Glasser MF",)], "a string").select(tt.without_initials(F.col("a")).alias("n"))
    assert [r["n"] for r in n.collect()] == ["Van Essen", "Glasser"]


def test_drawn_sample_obeys_its_rules(spark):
    d = spark.range(400).select("id", F.concat(F.lit("c"), F.col("id") % 7 % 4).alias("category"), F.concat(F.lit("U"), F.floor(F.col("id") / 14)).alias("label"))
    s = ca.draw_sample(d, 40, 2, ["U3"], 7).cache()
    assert 40 <= s.count() <= 44
    bad = ca.check_sample(s, d, d.filter("id < 0"), s.count(), 2, ["U3"])
    assert bad.count() == 0
    again = ca.draw_sample(d, 40, 2, ["U3"], 7)
    assert s.exceptAll(again).count() == 0


def test_verdicts_are_three_valued(spark):
    d = spark.createDataFrame([(True, False, True), (False, True, True), (False, False, True), (False, False, False)], "u boolean, v boolean, p boolean")
    got = [r["verdict"] for r in ck.verdicts(d, F.col("u"), F.col("v"), F.col("p")).collect()]
    assert got == ["unverified", "vacuous", "pass", "fail"]


def test_row_local_functions_run_on_a_stream(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([("bv-l-47", -3.0, 4.0, 5.0)], "raw string, x double, y double, z double").write.parquet(f"{base}/in")
    s = spark.readStream.schema("raw string, x double, y double, z double").parquet(f"{base}/in")
    run_available(s, lambda d: pt.encode_brain(ad.canonicalize(d, "raw"), "x", "y", "z", pt.literal_template(pt.ICBM152), 3), f"{base}/out", f"{base}/cp")
    assert spark.read.parquet(f"{base}/out").first()["cell"] == "BV-L-47"


def test_leave_one_out_equals_refitting(spark):
    import numpy as np

    from bodygrid.operators import mesh as ms

    rng = np.random.default_rng(3)
    rows = [(int(i), int(i % 2), *map(float, rng.normal(size=3)), *map(float, rng.normal(size=3))) for i in range(24)] + [(99, 7, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    p = spark.createDataFrame(rows, "id int, g int, x double, y double, z double, tx double, ty double, tz double")
    got = {r["id"]: r["loo_residual"] for r in ms.leave_one_out(p, "g").collect()}
    assert got.pop(99) is None
    for r in rows[:-1]:
        rest = np.array([o[2:] for o in rows[:-1] if o[1] == r[1] and o[0] != r[0]])
        c = np.linalg.lstsq(np.c_[rest[:, :3], np.ones(len(rest))], rest[:, 3:], rcond=None)[0]
        assert abs(got[r[0]] - np.linalg.norm(np.array([*r[2:5], 1.0]) @ c - np.array(r[5:]))) < 1e-8


def test_neighbouring_boxes_share_a_lattice(spark):
    from bodygrid.operators import mesh as ms

    b = spark.createDataFrame([("a", 0.0, 3.9), ("b", 4.3, 8.3), ("thin", 4.1, 5.9)], "box_id string, lo_x double, hi_x double")
    b = b.selectExpr("*", "0D AS lo_y", "0D AS hi_y", "-1D AS lo_z", "1D AS hi_z")
    assert sorted((r["box_id"], r["x"], r["z"]) for r in ms.lattice(b, 2.0).collect()) == [("a", 0.0, 0.0), ("a", 2.0, 0.0), ("b", 6.0, 0.0), ("b", 8.0, 0.0)]
