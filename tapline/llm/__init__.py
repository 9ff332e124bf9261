"""Operators of a training-data pipeline: dedup, decontamination, scoring, packing.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
