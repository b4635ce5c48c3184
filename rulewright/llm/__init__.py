"""Operators for preparing training corpora (packing, deduplication, scoring, decontamination).

Nothing else in the library imports this subpackage.
"""
