"""Tidewright: profile, plan, verify and clean tables of raw strings on Spark."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .operators.profile import Profile
    from .plans.execute import Applied


@dataclass
class Cleaned:
    plan: dict
    before: Profile
    applied: Applied


def clean(df: DataFrame, plan: dict | None = None, config=None) -> Cleaned:
    """Profiles and plans a table, or takes the plan given, and applies it."""
    from .operators.profile import frequencies, profile, with_row_id
    from .operators.reference import default_reference
    from .plans.execute import apply
    from .plans.planner import Config, heuristic

    df, config = with_row_id(df), config or Config()
    freq = frequencies(df).persist()
    try:
        before = profile(df, freq, (config.reference or default_reference(df.sparkSession)) if config.use_reference else None)
        plan = plan if plan is not None else heuristic(df, before, config, freq)
    finally:
        freq.unpersist()
    return Cleaned(plan, before, apply(df, plan))
