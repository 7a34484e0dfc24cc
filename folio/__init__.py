"""folio: a PySpark-native engine for curated document archives."""

__version__ = "0.1.0"
