"""Training-data operators: filtering, deduplication, mixing, scoring and archiving.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
