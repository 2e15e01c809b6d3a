"""Spark-native corpus analytics: convert, deduplicate, split, tokenize, score and report."""
