"""Velum: rating and catalogue analytics as lazy Spark DataFrame operators."""
