"""Quernstone: a PySpark-native analytics engine for conversation archives and text-heavy event data."""
