"""Operators for training-data pipelines: one module per operator, with their queries in ``queries``."""
