"""Spark-first processing of address data: records, look-ups, search and the clean-up around them."""

__version__ = "0.1.0"
