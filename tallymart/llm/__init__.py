"""Operators for preparing training corpora: near-dedup, archives, scans, quality, mixing, tokens, search, fingerprints."""
