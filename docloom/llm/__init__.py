"""Training-data operators: deduplication, archives, scoring, mixing and packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
