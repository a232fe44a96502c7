"""Operators for training-data pipelines: licence scans, near duplicates, LM
scores, URL filters, language labels, fingerprints, tokenisation, quality and
decontamination.  Nothing else in the library imports this subpackage."""
