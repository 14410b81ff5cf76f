"""Readers and writers (S1-S8) and views over the driver tables."""
