"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
