"""Readers, input normalization and sinks."""
