"""Margin, total and win-probability models on Spark ML."""
