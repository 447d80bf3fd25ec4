"""Recommender analytics as composable Spark DataFrame operators."""
