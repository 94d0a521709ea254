"""Operators for preparing training text: scoring, fingerprints, near-duplicates, decontamination, privacy, mixing."""
