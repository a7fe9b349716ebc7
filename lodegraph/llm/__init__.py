"""Operators for preparing training text: parsing checks, secrets, provenance, tokens, packing, encodings."""
