"""Operators for preparing large text corpora: ten dealt operators and the helpers they share."""
