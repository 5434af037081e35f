"""JSON documents: limits files and watch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.schemas import WATCH_LIST

WRAPPER = "parameters"
BOUNDS = ("warning_low", "warning_high", "alarm_low", "alarm_high")
WATCH_VERSION = 1


def _members(text: DataFrame) -> DataFrame:
    """Members of the top-level object, as raw JSON."""
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "json"))


#: Refused names that an error spells out; it counts the rest.
NAMED = 20


def named(refused: DataFrame, name: Column) -> str:
    """The first refused names in order, and how many more there are; empty if there are none."""
    first = [r[0] for r in refused.select(name.alias("n")).orderBy("n").limit(NAMED).collect()]
    more = refused.count() - NAMED if len(first) == NAMED else 0
    return ", ".join(first) + (f" and {more} more" if more else "")


def limits(spark: SparkSession, path: str) -> DataFrame:
    """Name to four optional thresholds; a ``parameters`` wrapper is optional.

    Unknown members are refused by name: a threshold nobody reads is one the operator believes
    is doing something.
    """
    text = spark.read.text(path, wholetext=True)
    if text.filter(F.from_json("value", "map<string,string>").isNull()).limit(1).count():
        raise ValueError(f"{path}: expected an object of parameter names")
    top = _members(text)
    names = [r.name for r in top.filter(F.col("name") == WRAPPER).limit(1).collect()]
    if names:
        beside = named(top.filter(F.col("name") != WRAPPER), F.col("name"))
        if beside:
            raise ValueError(f"{path}: unknown members beside `{WRAPPER}`: {beside}")
        top = top.select(F.explode(F.from_json("json", "map<string,string>")).alias("name", "json"))
    entries = top.withColumn("_m", F.from_json("json", "map<string,double>"))
    unknown = entries.select("name", F.explode(F.map_keys("_m")).alias("key")).filter(
        ~F.col("key").isin(*BOUNDS)
    )
    refused = named(unknown, F.concat(F.lit("`"), "key", F.lit("` of `"), "name", F.lit("`")))
    if refused:
        raise ValueError(f"{path}: unknown thresholds: {refused}")
    bad = named(entries.filter(F.col("_m").isNull()), F.col("name"))
    if bad:
        raise ValueError(f"{path}: not limit entries: {bad}")
    return entries.select(
        F.col("name").alias("parameter"), *[F.try_element_at("_m", F.lit(b)).alias(b) for b in BOUNDS]
    )


def watch_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(watched names, plot groups) of a saved layout; other versions and unknown keys are refused."""
    text = spark.read.text(path, wholetext=True)
    allowed = [part.strip().split(" ")[0] for part in _top_level(WATCH_LIST)]
    keys = {r.name for r in _members(text).select("name").collect()}
    strange = sorted(keys - set(allowed))
    if strange:
        raise ValueError(f"{path}: unknown keys: {', '.join(strange)}")
    layout = spark.read.schema(WATCH_LIST).json(path, multiLine=True)
    versions = [r.version for r in layout.select("version").limit(2).collect()]
    if versions != [WATCH_VERSION]:
        raise ValueError(f"{path}: layout version {versions} is not {WATCH_VERSION}")
    watched = layout.select(F.explode("watched").alias("name"))
    plots = layout.select(F.posexplode("plots").alias("plot_no", "_p")).select(
        "plot_no",
        F.col("_p.title").alias("title"),
        F.posexplode("_p.parameters").alias("ordinal", "name"),
    )
    return watched, plots


def _top_level(schema: str) -> list[str]:
    """Split a schema text at the commas outside angle brackets."""
    parts, depth, current = [], 0, ""
    for letter in schema:
        depth += (letter == "<") - (letter == ">")
        if letter == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += letter
    return [*parts, current]
