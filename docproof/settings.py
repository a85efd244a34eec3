"""The tunables, in one place. ``as_of`` stands for today and now, so that a plan gives the same rows each time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    as_of: str = "2001-01-15 12:00:00"
    print_as_of: str = "2024-06-30"
    auto_accept: float = 0.90
    high_stakes: float = 0.95
    document_penalty: float = 0.80
    qa_rate: float = 0.05
    amount_abs: str = "1.0"
    amount_rel: str = "0.00002"
    line_tolerance: str = "0.51"
    review_sla_minutes: int = 240
    retention_hours: int = 72
    retention_cap_hours: int = 168
    retention_grace_hours: int = 24
    seconds_per_field: int = 8
    least_fields: int = 200
    price_pct: str = "0.5"
    quantity_pct: str = "0"
    match_abs: str = "1.0"
    least_similarity: float = 70.0


DEFAULTS = Settings()
