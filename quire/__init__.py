"""Spark-native analytics over page layouts, extracted claims, code graphs and submissions."""
