"""Inputs of the registered queries."""

from checks.catalog_joins import resolve_bytes, resolve_runtime
from checks.views import OBS_ORDER, Views

FOLDER = "/root/testdata/sf0.001"


def test_observations_are_joined_once(spark):
    """The resolvers number their observations twice over; the join of lines and orders is not among what they repeat."""
    v = Views(spark, FOLDER)
    assert sorted(v.kept_obs.collect(), key=str) == sorted(v.obs.collect(), key=str)
    assert v.kept_obs.schema.names == v.obs.schema.names and set(OBS_ORDER) <= set(v.obs.columns)
    for run in (resolve_bytes, resolve_runtime):
        assert not any("orders.parquet" in f or "lineitem.parquet" in f for f in run(v).inputFiles())
