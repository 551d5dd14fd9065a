"""lexweave: a PySpark-native analytics engine for long, cross-referenced documents."""

__all__ = ["__version__"]
__version__ = "0.1.0"
