"""Stages of the engine: each takes DataFrames and returns one, lazily."""
