"""PySpark-native screening engine for collections of candidate documents."""

__version__ = "0.1.0"
