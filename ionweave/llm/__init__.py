"""Operators for training-data pipelines over web-scale text; nothing else in the package imports them."""
