"""Pinwall: a PySpark-native analytics engine for digitised note boards."""
