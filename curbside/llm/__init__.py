"""Operators for preparing large text corpora: deduplication, decontamination, quality,
packing, classification, token files, secret scans and token counts.

Nothing outside this subpackage imports it.
"""
