"""Name -> query and name -> oracle SQL. A query is a function of (spark, sf_dir), registered by ``query``."""

from __future__ import annotations

FLAGSHIP = "return_periods"

QUERIES: dict = {}
SQL: dict = {}
#: SQL that states a query at a size another engine manages, for tests: the catalogue of 40 years.
SMALL_SQL: dict = {}


def query(*ctes: str, sql: str | None = None, small: bool = False):
    """Register a query of one ``Tables`` argument; ``sql`` follows the common table expressions, and states a smaller
    size than the query's where ``small``."""

    def add(make):
        from cellweave.sources.tables import Tables

        def run(spark, sf_dir):
            return make(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            (SMALL_SQL if small else SQL)[make.__name__] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return make

    return add


def load() -> None:
    """Import every module that registers queries."""
    from cellweave.plans import artefacts, checks, climate, events, extremes, features, files, fine, ingest, legacy, older, simulation, streams, verification  # noqa: F401
