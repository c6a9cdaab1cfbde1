"""Operators for preparing large text collections (training data) with Spark."""
