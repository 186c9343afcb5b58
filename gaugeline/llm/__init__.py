"""Training-data operators: dedup, mixing, scans, scoring and filtering over ``documents``-like tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
