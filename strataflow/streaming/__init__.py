"""Reconciliation of live input, as a batch and as a stream."""
