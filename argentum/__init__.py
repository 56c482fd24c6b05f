"""A PySpark-native analytics engine for media-library catalogs."""

__version__ = "0.1.0"
