"""Every registered query against its SQL, and the others for rows."""

import pytest
from compare import database, difference
from pyspark.sql.functions import spark_partition_id

from fieldweave.plans.oracles import SQL
from fieldweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["pixel_mask_rings", "balanced_zone_stats", "grown_zones", "legacy_points", "sweep_points", "zone_polygons", "zone_tour", "budgeted_gaps", "field_zones", "gap_filled_zones"])
def test_no_grid_through_the_driver(spark, name):
    """Grids and rings are as many as the fields, however small a plan takes them to be; all pixels are above the limit."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        assert "BroadcastExchange" not in QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_outlines_are_covered_in_many_tasks(spark):
    """All outlines are few bytes, which adaptive execution merges into one task."""
    from fieldweave.operators.polygons import covered_cells
    from fieldweave.plans.queries import fields
    from fieldweave.sources.domain import rings

    cells = covered_cells(rings(fields(spark, "/root/testdata/sf0.01")), 16, 16)
    assert cells.select(spark_partition_id()).distinct().count() == 4


def test_rings_carry_no_rule(spark):
    """From a rule that says how rings follow from field_id, a join may infer a filter on the other side's field_id."""
    from fieldweave.plans.queries import fields
    from fieldweave.sources.domain import rings

    assert "transform" not in rings(fields(spark, SF))._jdf.queryExecution().optimizedPlan().constraints().toString()
