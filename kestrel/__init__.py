"""kestrel: business analytics and statistics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; the heavy
work is a Spark job (aggregations, joins, windows over bounded partitions),
never a loop over collected rows.
"""

__version__ = "0.1.0"
