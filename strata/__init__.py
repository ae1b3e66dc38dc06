"""strata: a Spark-native engine for searching, verifying and preparing long regulatory documents."""

__version__ = "0.1.0"
