"""tabweave: a Spark-native engine for tabular ingest, typed parsing and folds."""

__version__ = "0.1.0"
