"""Operators for training-data pipelines; nothing else in wirefold imports this subpackage."""
