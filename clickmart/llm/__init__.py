"""Operators for large text corpora: scoring, filtering, deduplication, decontamination and packing."""
