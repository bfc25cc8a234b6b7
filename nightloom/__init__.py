"""Nightloom: Spark-native analytics over dated, partly located free-text reports."""
