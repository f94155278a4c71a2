"""Named queries over the driver's tables: Spark builders and DuckDB oracles."""


def load_all():
    """Import every query module so that the registry is complete."""
    from terrastate.plans import element_queries, geo_queries, ownership_queries, stream_queries  # noqa: F401
    from terrastate.plans.registry import QUERIES

    return QUERIES
