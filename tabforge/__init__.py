"""Spark-native engine that profiles, cleans, prepares, models and evaluates labelled tables."""
