"""Operators of a training-data pipeline: ten methods, each a Spark job over whole tables."""
