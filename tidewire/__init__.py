"""Spark-native news-event analytics: text, facts, dedupe, source health and reports."""
