"""rowgraph: an entity graph over text columns, planned by Spark.

Entities, mentions and edges are derived from ordinary DataFrames and read
through a row policy, so that a caller sees an element exactly when the rows
that support it are readable to them.
"""

__version__ = "0.1.0"
