"""A spread of registered queries against their SQL on the smallest tables. The whole set: python tests/compare.py."""

import os

import pytest

from compare import compare, connect

from bodygrid.plans import load

SF = "/root/testdata/sf0.001"
NAMES = [
    "canonical_cells", "rows_inside_structures", "normalized_coverings", "resolve_cells", "index_revision_diff", "encode_brain_points",
    "paper_validation", "resolve_corpus", "browse_by_anatomy", "term_route_links", "matched_citations", "mesh_components", "points_in_solids", "same_place_pairs", "provenance_groups",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    reg = load()
    msg, ok = compare(spark, con, name, reg.QUERIES[name], reg.ORACLES[name], SF)
    assert ok, msg


def test_every_query_has_sql_or_is_listed():
    reg = load()
    assert set(reg.QUERIES) == set(reg.ORACLES)
