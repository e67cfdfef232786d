"""Operators of a large-scale training-data pipeline (one module per operator).

``queries`` registers one query per operator; ``__spark_entry__`` adds them only
if this package can be imported. Nothing outside this package imports it.
"""
