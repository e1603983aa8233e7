"""Named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from sheetweave.plans import join_queries, more_queries, scalar_queries

QUERIES = {**scalar_queries.QUERIES, **join_queries.QUERIES, **more_queries.QUERIES}
SQL = {**scalar_queries.SQL, **join_queries.SQL, **more_queries.SQL}
