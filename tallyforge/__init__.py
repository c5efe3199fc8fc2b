"""tallyforge: a PySpark-native engine for panel analytics and training-data pipelines."""

__version__ = "0.1.0"
