"""Relational operators: pairing, matching, graphs, tracks, observations, clouds, display deltas, statistics."""
