"""Whole plans: the corpus build and the registered queries."""
