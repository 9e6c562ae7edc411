"""An index is audited by structure: members are never paired with the cells of other structures."""

from bodygrid.functions import address as ad
from bodygrid.operators import names as nm


def test_members_meet_their_own_structure_only(spark):
    rows = [("a", "BV-L-1"), ("a", "BV-L-12"), ("b", "BV-L-1"), ("b", "BV-L-2"), ("c", "BV-L-12"), ("c", "BV-L-12"), ("d", "BD-T01-01I")]
    audit = nm.audit_index(ad.with_key(spark.createDataFrame(rows, "structure_id string, cell string"), "cell"))
    assert sorted((r["rule"], r["row_id"], r["message"]) for r in audit.collect()) == [("nested_cell", "a", "BV-L-12"), ("repeated_cell", "c", "BV-L-12")]
    joins = [x for x in audit._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and all("structure_id" in x for x in joins)
