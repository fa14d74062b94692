"""leafmill: a Spark-native document analytics engine.

Documents are tables.  Every operator takes a DataFrame and returns one, so
Catalyst sees the whole plan and a cluster sees only keyed, partitioned rows.
"""

__version__ = "0.1.0"
