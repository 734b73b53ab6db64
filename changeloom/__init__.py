"""changeloom: Spark-native operators over change-set corpora.

Every public operator is a function from DataFrames (or Columns) to a DataFrame (or Column).  Per-record work is
expressed as column expressions, so it never shuffles; corpus-level work is expressed as joins, aggregations and
windows whose hot keys are split before they reach one task.
"""

__version__ = "0.1.0"
