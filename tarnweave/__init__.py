"""tarnweave: a PySpark-native engine for curating, searching and evaluating text corpora."""

__version__ = "0.1.0"
