"""cuewright: a PySpark-native engine for time-coded container data."""

__version__ = "0.1.0"
