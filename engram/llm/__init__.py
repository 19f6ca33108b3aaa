"""Training-data operators: deduplication, decontamination, chat formatting, tokenising, scoring, sharding.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
