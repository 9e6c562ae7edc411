"""Equal points meet the levels of their template once; the coarsest cell needs no row for each ancestor."""

from bodygrid.functions import address as ad
from bodygrid.operators import body as bd
from test_bodies import bent


def test_equal_points_are_brought_together_before_they_meet_levels(spark):
    lv = bd.spine_levels(bent(spark, 0.1, 60.0))
    p = spark.createDataFrame([(1, "t", 5.1, 7.2, -11.3)] * 3 + [(2, "u", 1.0, 2.0, 3.0)] * 2, "id int, template_id string, x double, y double, z double")
    d = bd.encode_body(p, lv, 3)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :].split("Window")[0]  # below the join, on the side of the points
    assert sorted((r["id"], r["error_code"]) for r in d.collect()) == [(1, None)] * 3 + [(2, "no_template")] * 2


def test_coarsest_cell_is_the_level_the_template_has(spark):
    geo = bd.geometry(bd.spine_levels(bent(spark, 0.1, 60.0)))
    rows = [("t", "BD-T02-03I-123"), ("t", "BD-T02"), ("t", "BD-L01-03I-1"), ("u", "BD-T02-03I")]
    cells = ad.with_key(spark.createDataFrame(rows, "template_id string, cell string")).drop("cell")
    d = bd.coarsest_resolvable(cells.unionByName(cells), geo)
    assert "explode" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
    text = d.select("template_id", ad.cell_text(d["cell_key"]).alias("c"), ad.cell_text(d["coarsest"]).alias("a"))
    assert sorted(map(tuple, text.collect()), key=lambda r: (r[0], r[1])) == [("t", "BD-L01-03I-1", None), ("t", "BD-T02", "BD-T02"), ("t", "BD-T02-03I-123", "BD-T02"), ("u", "BD-T02-03I", None)]
