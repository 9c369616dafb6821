"""All registered queries. Importing the modules registers them."""

from panelwise.catalog import base, drifts, fits, panels, scalars, stores  # noqa: F401

QUERIES, SQL = base.QUERIES, base.SQL
