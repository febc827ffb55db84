from kestrel.sources.tables import table, sales, ab_events, register_views, TABLES  # noqa: F401
