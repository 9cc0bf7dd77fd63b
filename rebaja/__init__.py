"""Retail markdown and price analytics as Spark DataFrame operators."""
