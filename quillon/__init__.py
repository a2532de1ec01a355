"""Quillon: provenance-first text corpora as DataFrame plans."""
