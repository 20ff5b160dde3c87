"""squallframe: a PySpark-native engine for catalogued storm-event imagery and the tables derived from it."""

__version__ = "0.1.0"
