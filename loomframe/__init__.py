"""loomframe: a PySpark-native analytics engine with R-style data-frame semantics."""

__version__ = "0.1.0"
