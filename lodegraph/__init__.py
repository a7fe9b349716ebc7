"""lodegraph: Spark-native analytics over software-metadata graphs and source text."""

__version__ = "0.1.0"
