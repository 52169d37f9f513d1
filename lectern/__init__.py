"""lectern: a PySpark-native engine for ingesting and querying document corpora."""

__version__ = "0.1.0"
