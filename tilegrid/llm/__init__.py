"""Training-data operators: counting, scoring, filtering, deduplicating and packing text.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
