"""engram: a Spark-native analytics engine for the memory of coding agents."""

__version__ = "0.1.0"
