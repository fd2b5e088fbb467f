"""quillon: a PySpark-native engine for representational-similarity analytics and data curation."""

__version__ = "0.1.0"
