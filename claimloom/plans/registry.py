"""All queries outside the training-data subpackage, and their SQL."""

from claimloom.plans import core, more  # noqa: F401  more adds to core

QUERIES = dict(core.QUERIES)
SQL = dict(core.SQL)
