"""Readers, normalisers and table maintenance."""
