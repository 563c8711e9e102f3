"""Training-data operators: dedup, extraction, filtering, mixing, packing and token storage.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
