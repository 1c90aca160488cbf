"""Dataflow operators over dialogue, prediction and audit tables."""
