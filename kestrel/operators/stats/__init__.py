"""Statistical tests as Spark jobs: sufficient statistics by aggregation,
closed forms on one row per test (and per segment with ``by=[...]``)."""
