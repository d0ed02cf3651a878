"""Operators for preparing training data: mixing, deduplication, scanning, scoring and packing of documents."""
