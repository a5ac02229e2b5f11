"""PySpark-native engine for long-range redundancy analysis and block-oriented data reduction."""

__version__ = "0.1.0"
