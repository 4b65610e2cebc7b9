"""Plinth: a PySpark-native engine for agenda extraction, serving queries and corpus preparation."""
