"""Operators of a training-data pipeline: ten of them, each a DataFrame -> DataFrame function with its own module."""
