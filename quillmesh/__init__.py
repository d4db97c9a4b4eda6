"""Quillmesh: conversational-memory analytics as lazy Spark DataFrame stages."""

__version__ = "0.1.0"
