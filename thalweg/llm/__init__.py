"""Operators for preparing training data: deduplication, filtering, decontamination and packing."""
