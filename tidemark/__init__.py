"""tidemark: Spark-native validation and risk analytics for time-series return streams."""

__version__ = "0.1.0"
