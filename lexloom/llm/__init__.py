"""Training-data operators: deduplication, quality, packing, search and scoring.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
