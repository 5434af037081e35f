"""The table of named queries: what each covers, how to build it, and its SQL cross-check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    covers: tuple[str, ...]
    build: Build
    oracle: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, covers: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``; ``covers`` lists the SURVEY rows it answers."""

    def register(build: Build) -> Build:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = Plan(name, tuple(covers.split()), build, oracle)
        return build

    return register
