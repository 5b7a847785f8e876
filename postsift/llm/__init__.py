"""Operators for preparing training text: deduplication, decontamination, tokenizing, classifiers."""
