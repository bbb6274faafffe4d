"""Training-data operators: quality, toxicity, deduplication, tokens, scoring, packing and sharding.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
