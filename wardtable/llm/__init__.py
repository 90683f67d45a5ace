"""Operators for training-data pipelines: ten methods, each a module of its own."""
