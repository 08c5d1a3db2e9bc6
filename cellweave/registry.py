"""Every query of the library by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .plans import core, fields, files, models, reports, scenarios, surfaces  # noqa: F401  (these add their queries to those of core)

QUERIES = {**core.QUERIES}
SQL = {**core.SQL}
