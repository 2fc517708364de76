"""Training-data operators: dedup, quality, language, toxicity, mixing and packing.

Nothing else in the library imports this subpackage.
"""
