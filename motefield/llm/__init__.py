"""Operators for preparing training text: encoding, output, fingerprints, scans, scores and deduplication."""
