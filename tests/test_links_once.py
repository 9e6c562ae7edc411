"""Mappings meet links and reasons of their terms in one join, and index sides are compared in one shuffle."""

from bodygrid.operators import crosswalk as xw


def test_mappings_meet_links_and_reasons_in_one_join(spark):
    m = spark.createDataFrame([("m1", "f1", "p1", "S", "S:1", "one"), ("m2", "f1", "p1", "S", "S:2", "two"), ("m3", "f2", "p2", "S", "S:1", "one")], "mapping_id string, finding_id string, paper_id string, structure_source string, structure_id string, structure_label string")
    link = "scheme string, term string, representation string, structure_id string, name string, side string, how string, precision string, why string, completeness string, held_targets string"
    links = spark.createDataFrame([("S", "S:1", "r", "1", "n", "left", "exact-term", "exact", None, None, None)], link)
    reasons = spark.createDataFrame([("S", "S:2", "no-crosswalk-entry", "no entry for S:2")], "scheme string, term string, code string, detail string")
    d = xw.link_terms(m, links, reasons)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = sorted((r["mapping_id"], r["is_link"], r["structure_id"], r["code"], r["route"]) for r in d.collect())
    assert got == [("m1", True, "1", None, None), ("m2", False, None, "no-crosswalk-entry", "term"), ("m3", True, "1", None, None)]


def test_differences_of_sides(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "paper_id string, region_key string, n long")
    a, b = side(("p", "r", 1), ("p", "s", 2), ("p", "s", 2), (None, "t", 1)), side(("p", "r", 1), (None, "t", 1), ("q", "r", 1))
    d = xw._differences({"a": a, "b": b}, [("a_not_b", "a", "b"), ("b_not_a", "b", "a")], ["paper_id", "region_key", "n"])
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = sorted((r["rule"], r["paper_id"] or "", r["region_key"]) for r in d.collect())
    assert got == [("a_not_b", "", "t"), ("a_not_b", "p", "s"), ("a_not_b", "p", "s"), ("b_not_a", "", "t"), ("b_not_a", "q", "r")]
