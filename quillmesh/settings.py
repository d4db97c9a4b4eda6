"""Settings of a corpus build."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    session_size: str = "medium"  # small, medium, large
    concept_level: str = "medium"  # low, medium, high
    include_symbolic: bool = True
    enable_delta: bool = True
