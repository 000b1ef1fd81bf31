"""Training-data operators: mixing, packing, toxicity, extraction, quality, near-duplicates, repeated passages, language model scoring, cleaning and vector search.

Nothing outside this subpackage imports it.  ``shardwell.llm.registry`` holds the queries built on these operators.
"""
