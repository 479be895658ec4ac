"""All registered queries of the engine."""

from . import catalogue, checks, front

assert checks and front  # they register their queries on import
QUERIES, ORACLE = catalogue.QUERIES, catalogue.ORACLE
