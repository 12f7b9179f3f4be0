"""Operators for preparing large text corpora: scoring, encoding, filtering, dedup, packing."""
