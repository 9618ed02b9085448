"""Operators for preparing training corpora: deduplication, search, scans, classifiers, tokens and packing."""
