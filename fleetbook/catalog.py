"""All registered queries (reads, writes, checks, streams) and their oracle SQL."""

from fleetbook import catalog_checks, catalog_reads, catalog_writes  # noqa: F401  (registration)

QUERIES = dict(catalog_reads.QUERIES)
ORACLE = dict(catalog_reads.ORACLE)
