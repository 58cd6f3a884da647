"""Spark-native analytics over library, spreadsheet and corpus tables."""
