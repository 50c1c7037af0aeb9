"""weft: Spark-native network-module analytics over wide numeric tables."""

__version__ = "0.1.0"
