"""tessera: a Spark-native feature-engineering engine.

Fit is an aggregate to a small state table; transform is a lazy plan of
expressions, windows and lookups joined on the state.
"""

__version__ = "0.1.0"
