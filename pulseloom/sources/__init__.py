"""Readers, normalisers, adapters, synthetic data and sinks."""
