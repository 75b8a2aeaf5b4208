"""Ravelin: a PySpark-native document intelligence and hybrid retrieval engine."""
