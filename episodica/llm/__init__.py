"""Operators that prepare training corpora: sharding, extraction, scans, language ID, fingerprints, search, mixing, dedup, packing, token counts."""
