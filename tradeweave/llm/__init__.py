"""Operators of a training-data pipeline: one module per operator, one thin query each.

``queries`` holds the registered ``opN_<name>`` queries and their SQL twins.
Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
