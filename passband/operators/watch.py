"""Watch lists and plot groups as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.operators.store import orphans, resolve


def names_in_use(watch: DataFrame, plots: DataFrame) -> DataFrame:
    """Watched and plotted names, each once."""
    return watch.select("name").union(plots.select("name")).distinct()


def resolved(watch: DataFrame, plots: DataFrame, definition: DataFrame) -> DataFrame:
    """Distinct parameters a layout asks for; two names of one parameter count once."""
    return resolve(names_in_use(watch, plots), definition).select("parameter").distinct()


def captured(watch: DataFrame, watched_parameters: DataFrame, definition: DataFrame) -> DataFrame:
    """The list to keep: names the definition lacks, and what is watched now."""
    kept = orphans(watch.select("name"), definition)
    return kept.union(watched_parameters.select(F.col("parameter").alias("name"))).distinct()


def plot_members(plots: DataFrame, definition: DataFrame) -> DataFrame:
    """(plot, ordinal) to parameter; names that do not resolve are skipped."""
    return resolve(plots, definition).select("plot_no", "ordinal", "parameter")
