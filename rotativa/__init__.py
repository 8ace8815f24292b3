"""rotativa: a Spark-native analytics engine for press-coverage corpora."""

__version__ = "0.1.0"
