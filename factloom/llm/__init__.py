"""Training-data operators: tokenising, extraction, filtering, deduplication and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
