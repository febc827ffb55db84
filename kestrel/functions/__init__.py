from kestrel.functions.columns import (  # noqa: F401
    agg_column, numeric_col, timestamp_col, key_equals, is_numeric_type, require_columns,
)
