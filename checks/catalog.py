"""Imports every catalogue so that its queries are registered."""

from checks import (  # noqa: F401
    catalog_aggregates, catalog_data, catalog_joins, catalog_streams, catalog_values, catalog_windows)
