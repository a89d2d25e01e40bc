"""quern: a Spark-native engine for exploring, comparing, editing and versioning tabular datasets."""

__version__ = "0.1.0"
