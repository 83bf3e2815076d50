"""Operators for large-scale training-data pipelines. Nothing else in hubbub imports this subpackage."""
