"""Training-data operators: dedup, decontamination, redaction, tokens, packing, scoring, sharding.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
