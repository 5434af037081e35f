"""Named queries over the given tables, grouped by subject."""

from __future__ import annotations

import importlib

from passband.plans.registry import PLANS, Plan

SUBJECTS = ("quality", "values", "decoding", "plotting", "framing", "statistics", "live", "files")


def load() -> dict[str, Plan]:
    for subject in SUBJECTS:
        importlib.import_module(f"passband.plans.{subject}")
    return PLANS
