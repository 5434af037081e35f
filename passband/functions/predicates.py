"""Value and name predicates as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of value that have a number: they can be plotted and compared with limits.
PLOTTABLE = ("Unsigned", "Signed", "Float", "Bool")

#: Limit states, worst last.
UNKNOWN, NOMINAL, WARNING, ALARM = range(4)


def contains_ascii_fold(haystack: Column, needle: str) -> Column:
    """Substring test that folds ASCII letters only; an empty needle matches everything."""

    def fold(text: Column) -> Column:
        return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)

    return fold(haystack).contains(fold(F.lit(needle)))


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Both ends optional and inclusive; NaN is inside nothing."""
    return (
        ~F.isnan(value)
        & F.coalesce(value >= low, F.lit(True))
        & F.coalesce(value <= high, F.lit(True))
    )


def limit_state(
    value: Column,
    warning_low: Column,
    warning_high: Column,
    alarm_low: Column,
    alarm_high: Column,
) -> Column:
    """0 unknown, 1 nominal, 2 warning, 3 alarm; the alarm range is tested first."""
    alarm_set = alarm_low.isNotNull() | alarm_high.isNotNull()
    warning_set = warning_low.isNotNull() | warning_high.isNotNull()
    return (
        F.when(value.isNull() | F.isnan(value), UNKNOWN)
        .when(alarm_set & ~in_range(value, alarm_low, alarm_high), ALARM)
        .when(warning_set & ~in_range(value, warning_low, warning_high), WARNING)
        .when(alarm_set | warning_set, NOMINAL)
        .otherwise(UNKNOWN)
    )


def number_of(value: Column) -> Column:
    """The number behind a tagged value struct (kind, i, f, b, s, x): bool is 0/1, text has none."""
    return F.coalesce(
        value["i"].cast("double"), value["f"], value["b"].cast("int").cast("double")
    )


def is_plottable(kind: Column) -> Column:
    return kind.isin(*PLOTTABLE)


def same_value(a: Column, b: Column) -> Column:
    """Per-kind exact equality of two tagged values.  NaN equals nothing, itself included."""
    fields = [a[n].eqNullSafe(b[n]) for n in ("i", "f", "b", "s", "x")]
    same = a["kind"] == b["kind"]
    for field in fields:
        same = same & field
    return same & ~F.coalesce(F.isnan(a["f"]), F.lit(False))


def value_struct(
    kind: str | Column,
    *,
    i: Column | None = None,
    f: Column | None = None,
    b: Column | None = None,
    s: Column | None = None,
    x: Column | None = None,
) -> Column:
    """A tagged value; the fields of other kinds are null."""

    def typed(column: Column | None, name: str, to: str) -> Column:
        return (F.lit(None) if column is None else column).cast(to).alias(name)

    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        typed(i, "i", "decimal(20,0)"),
        typed(f, "f", "double"),
        typed(b, "b", "boolean"),
        typed(s, "s", "string"),
        typed(x, "x", "binary"),
    )
