"""Readers, sinks and the deterministic planting of attacks into the given tables."""
