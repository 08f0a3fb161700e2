"""Operators of a training-data pipeline: one module each, with its query beside it.

``REGISTRY`` in ``queries`` names what ``__spark_entry__`` publishes.
"""
