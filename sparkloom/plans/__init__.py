"""The registered queries of the engine's own operators, and their SQL."""

from . import extra, relational, reports, search

QUERIES = {**relational.QUERIES, **search.QUERIES, **extra.QUERIES, **reports.QUERIES}
SQL = {**relational.SQL, **search.SQL, **extra.SQL, **reports.SQL}
