"""Operators for training data: proportional samples, grouped splits, overlaps, token ids, mixtures, sentences.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
