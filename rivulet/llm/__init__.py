"""Operators for preparing training data: mixing, decontamination, fingerprints,
classification, extraction, formatting, de-duplication and secret scanning.

Nothing outside this subpackage imports it.
"""
