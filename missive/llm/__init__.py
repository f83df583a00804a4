"""Training-data operators: one module per operator, queries in ``catalog``.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
