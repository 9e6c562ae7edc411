"""Joins with an exploded table are broadcast by what it measures, not by the size of what it came from."""

import pytest
from pyspark.sql import functions as F

from bodygrid.operators import coverings as cv
from bodygrid.plans.registry import QUERIES, query
from bodygrid.session import PLANNED_BROADCAST, broadcast_by_size

PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def settings(spark):
    yield spark.conf
    spark.conf.unset(PLANNED)
    spark.conf.unset(MEASURED)


def probe(spark, path):
    """Cells of a stored table, each in the covering of its id."""
    return cv.maximal_cells(spark.read.parquet(path), ["covering_id"])


def test_exploded_tables_are_not_planned_as_broadcasts(spark, settings, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(200_000).select((F.col("id") % 1000).alias("covering_id"), (F.col("id") * 16 + 13).alias("cell_key")).write.parquet(path)
    query()(probe)
    try:
        before = settings.get(PLANNED)
        plan = QUERIES["probe"](spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        del QUERIES["probe"]
    assert "BroadcastHashJoin" not in plan
    assert settings.get(MEASURED) == before and int(settings.get(PLANNED)) == PLANNED_BROADCAST


@pytest.mark.parametrize("given", ["-1", "10k", "4096b"])
def test_lower_thresholds_stay(spark, settings, given):
    settings.set(PLANNED, given)
    broadcast_by_size(spark)
    assert settings.get(PLANNED) == given
