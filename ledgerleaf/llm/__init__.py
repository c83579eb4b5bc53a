"""Operators for large-scale training-data pipelines.

Each module holds one operator; ``registry`` turns them into the ``opN_`` queries.
Nothing outside this subpackage imports it.
"""
