"""Operators for preparing training text: quality, duplicates, fingerprints, toxicity, language
models, token counts, personal data, language, byte-pair encoding and benchmark leaks.

Nothing outside this subpackage imports it.
"""
