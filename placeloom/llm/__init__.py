"""Operators for text that is to train a model. Nothing else in the library imports this."""
