"""Operators of a training-data pipeline.

One module per operator; ``queries`` registers ``opN_<name>`` and ``pipeline``.
Nothing outside this subpackage imports it except ``__spark_entry__``, which
does so only if it is present.
"""
