"""quire: a Spark-native engine for document analytics and its evaluation."""

__version__ = "0.1.0"
