"""Operators that prepare training corpora: counting, packing, deduplication, filtering and masking."""
