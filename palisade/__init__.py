"""Palisade: a PySpark-native content-scanning and integrity-analytics engine."""
