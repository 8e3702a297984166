"""Operators for preparing training data: one module per operator.

Nothing outside this subpackage imports it; `queries.py` lists the registered
queries and `corpus_pipeline.py` at the repository top chains five of them.
"""
