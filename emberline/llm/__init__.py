"""Operators for training-data pipelines: one module for each, registered in ``catalog``."""
