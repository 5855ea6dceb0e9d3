"""Spark-native analytics over source code risk: scoring, baselines, churn, statistics."""
