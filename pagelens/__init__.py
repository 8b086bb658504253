"""pagelens: a Spark-native analytics engine for captured web corpora."""

__version__ = "0.1.0"
