"""Operators of a training-data pipeline. Nothing else in vagari imports this package."""
