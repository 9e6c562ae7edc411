"""Mappings are placed and resolved from their own rows; tables kept for a session are files, shuffles don't outlive their action."""

from bodygrid.functions import address as ad
from bodygrid.functions import points as pt
from bodygrid.operators import corpus as co
from bodygrid.plans import q_names as qn
from bodygrid.plans.registry import QUERIES

COLS = "mapping_id string, finding_id string, paper_id string, structure_id string, structure_label string, kind string, cells array<string>, digits int, frame string, points array<array<double>>"


def tables(spark):
    at = [[10.0, 20.0, 30.0]]
    row = lambda i, s, kind, cells=None, frame=None, points=None: (i, f"f{i}", "p", s, f"label {s}", kind, cells, 4, frame, points)
    m = [
        row("m1", "S:1", "region-level"), row("m2", "S:2", "region-level"), row("m3", "S:3", "region-level"),
        row("m4", "S:1", "cells", ["BV-L-1", "BV-L-12", "bv-l-12", "BV-L-9"]), row("m5", "S:1", "cells", ["BV-L-9"]), row("m6", "S:3", "cells", ["BV-L-2"]),
        row("m7", "S:1", "coordinates", None, "BV", at * 2), row("m8", "S:1", "coordinates", None, "BD", at), row("m9", "S:1", "coordinates", None, "BV", [[float("nan")] * 3]),
        row("m10", "S:1", "guess"), row("m11", "S:1", "cells", ["BV-R"]),
    ]
    index = ad.with_key(spark.createDataFrame([("S:1", "BV-L-12"), ("S:1", "BV-L-13"), ("S:2", "BV-L-4")], "structure_id string, cell string")).drop("cell")
    names = spark.createDataFrame([("S:1", "one"), ("S:3", "three")], "structure_id string, structure_name string")
    return spark.createDataFrame(m, COLS), index, names


def test_mappings_are_resolved_from_their_own_rows(spark):
    m, index, names = tables(spark)
    placed = co.place_mappings(m, pt.literal_template(pt.ICBM152))
    assert {r["mapping_id"]: len(r["keys"]) for r in placed.collect()} == {"m4": 2, "m5": 0, "m6": 1, "m7": 1, "m8": 0, "m9": 0, "m10": 0, "m11": 1}
    d = co.resolve_mappings(m, placed, index, names, ["BV"])
    got = {r["mapping_id"]: (r["unresolved_reason"], r["share_inside"]) for r in d.collect()}
    assert got == {
        "m1": (None, None), "m2": ("unknown-structure", None), "m3": ("empty-covering", None), "m4": (None, 0.25), "m5": ("empty-covering", None), "m6": (None, None),
        "m7": (None, None), "m8": ("no-template", None), "m9": ("bad-coordinates", None), "m10": ("empty-covering", None), "m11": (None, 0.0),
    }
    cells = co.mapping_cells(m, placed, index, names, ["BV"])
    assert sorted((r["mapping_id"], r["region_level_only"]) for r in cells.collect()) == [("m1", True)] * 2 + [("m11", False)] + [("m4", False)] * 2 + [("m6", False), ("m7", False)]


def test_what_a_query_leaves_on_disk(spark, tmp_path):
    build = qn.stored("files of a test")(lambda spark, sf: spark.range(1000).selectExpr("id", "null AS x").selectExpr("id", "string(x) AS x"))
    kept = build(spark, str(tmp_path))
    assert kept.count() == 1000 and all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
    try:
        QUERIES["stable_slots"](spark, str(tmp_path))
    except Exception:  # the tables it reads aren't here; settings are made before
        pass
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
