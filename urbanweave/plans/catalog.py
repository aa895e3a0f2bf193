"""All registered queries of the urban library, with the SQL that checks them."""

from urbanweave.plans import extra_queries, geometry_queries, grid_queries, joins_queries, lineage_queries, scene_queries, shape_queries, sink_queries, stats_queries, surface_queries, windows_queries  # noqa: F401
from urbanweave.plans.registry import ORACLE_SQL, QUERIES, WITHOUT_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "WITHOUT_SQL"]
