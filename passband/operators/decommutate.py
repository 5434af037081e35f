"""Decommutation: packets to parameter samples, compiled from a definition to columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passband.functions import bits, timecode
from passband.functions.predicates import value_struct
from passband.functions.text import REFUSALS, label
from passband.sources.definition import Calibrator, Definition, Match, ParameterType, Test

OPERATORS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Clock:
    """Which parameter carries spacecraft time, and how to read it."""

    parameter: str
    code: str  # cuc, cds or seconds
    layout: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    kind: ParameterType


Value = Callable[[Field], Column]


def _is_number(f: Field) -> bool:
    return f.kind.kind not in ("binary", "string")


def _is_calibrated(f: Field) -> bool:
    return f.kind.kind in ("integer", "float") and bool(f.kind.default or f.kind.contexts)


def _is_wide(f: Field) -> bool:
    return _is_number(f) and f.kind.size == 64 and f.kind.encoding == "unsigned"


def calibrate(calibrator: Calibrator, x: Column) -> Column:
    """A polynomial or a spline over a DOUBLE; null where the calibrator refuses its input."""
    if calibrator.terms:
        out = None
        for coefficient, exponent in calibrator.terms:
            power = x if exponent == 1 else F.pow(x, F.lit(float(exponent)))
            term = F.lit(coefficient) if exponent == 0 else F.lit(coefficient) * power
            out = term if out is None else out + term
        return F.when(x.isNotNull(), out)
    points = calibrator.points
    if len(points) < 2:
        return F.lit(None).cast("double")

    def along(low: tuple[float, float], high: tuple[float, float]) -> Column:
        slope = (high[1] - low[1]) / (high[0] - low[0])
        return F.lit(low[1]) + F.lit(slope) * (x - F.lit(low[0]))

    out = F.lit(None).cast("double")
    if calibrator.order == 0:
        for raw, value in points:
            out = F.when(x >= raw, F.lit(value)).otherwise(out)
        below, above = F.lit(points[0][1]), F.lit(points[-1][1])
    else:
        for low, high in reversed(list(zip(points, points[1:]))):
            out = F.when((x >= low[0]) & (x <= high[0]), along(low, high)).otherwise(out)
        below, above = along(points[0], points[1]), along(points[-2], points[-1])
    if calibrator.extrapolate:
        return F.when(x < points[0][0], below).when(x > points[-1][0], above).otherwise(out)
    return F.when((x >= points[0][0]) & (x <= points[-1][0]), out)


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, however often later stages use them.

    A stacked projection would be merged with the ones above it and every use expanded in
    place; a generator of exactly one row is not.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


class Decommutator:
    """Column expressions for every container under one root.

    Everything is decided on the driver, once: which containers a packet may be, where each
    field lies, which calibrator applies.  What is left per packet is arithmetic on columns.
    """

    def __init__(self, definition: Definition, root: str | None = None, octets: str = "bytes"):
        self.definition = definition
        self.octets = F.col(octets)
        bases = {c.base for c in definition.containers.values() if c.base}
        roots = [c.name for c in definition.containers.values() if c.base is None and c.name in bases]
        if root is None:
            if len(roots) != 1:
                raise ValueError(f"ambiguous root container: {sorted(roots)}")
            root = roots[0]
        if root not in definition.containers:
            raise ValueError(f"no such container: {root}")
        self.root = root
        self.concrete = [
            n for n, c in definition.containers.items() if not c.abstract and root in self._chain(n)
        ]
        if not self.concrete:
            raise ValueError(f"no packet type is described under {root}")

    def _chain(self, name: str) -> list[str]:
        chain, at = [], name
        while at is not None:
            if at in chain:
                raise ValueError(f"container {name} inherits from itself")
            chain.append(at)
            at = self.definition.containers[at].base
        return chain[::-1]

    def _entries(self, name: str) -> list[str]:
        out: list[str] = []
        for sort, ref in self.definition.containers[name].entries:
            out += [ref] if sort == "parameter" else self._entries(ref)
        return out

    def fields(self, name: str) -> list[Field]:
        """Entries of a container, inherited ones first, with their bit offsets."""
        out, offset = [], 0
        for part in self._chain(name):
            for parameter in self._entries(part):
                kind = self.definition.types[parameter]
                out.append(Field(parameter, offset, kind))
                offset += kind.size
        return out

    def described_bits(self, name: str) -> int:
        return sum(f.kind.size for f in self.fields(name))

    # ------------------------------------------------------------------ octets to numbers

    def _number(self, f: Field) -> Column:
        if f.kind.ieee:
            return bits.ieee754(self.octets, f.offset, f.kind.size)
        if f.kind.encoding in ("twosComplement", "signed"):
            return bits.signed(self.octets, f.offset, f.kind.size)
        return bits.unsigned(self.octets, f.offset, f.kind.size)

    def _octets(self, f: Field) -> Column:
        if f.offset % 8 or f.kind.size % 8:
            raise ValueError(f"{f.name}: octet fields must lie on octet boundaries")
        return F.substring(self.octets, f.offset // 8 + 1, f.kind.size // 8)

    # ------------------------------------------------------------------ numbers to values

    def _label(self, f: Field, number: Column) -> Column:
        if not f.kind.labels:
            return F.lit(None).cast("string")
        return label(number.cast("bigint"), dict(f.kind.labels))

    def _test(
        self, test: Test, decoded: dict[str, Field], value: Value, own: Field | None
    ) -> Column:
        """One comparison; a parameter not decoded yet stands for the field's own raw value."""
        compare = OPERATORS.get(test.operator)
        if compare is None:
            raise ValueError(f"unsupported comparison operator {test.operator!r}")
        subject = decoded.get(test.parameter, own)
        if subject is None:
            raise ValueError(f"criterion on {test.parameter}, which is not decoded before it")
        number = value(subject)
        if test.parameter in decoded and test.calibrated:
            if subject.kind.kind == "enumerated":
                return compare(self._label(subject, number), F.lit(test.value))
            if _is_calibrated(subject):
                return compare(self._calibrated(subject, decoded, value), F.lit(float(test.value)))
        if subject.kind.ieee:
            return compare(number, F.lit(float(test.value)))
        return compare(number.cast("bigint"), F.lit(int(test.value, 0)))

    def _matches(
        self, match: Match, decoded: dict[str, Field], value: Value, own: Field | None = None
    ) -> Column:
        out = F.lit(True)
        for test in match.every:
            out = out & self._test(test, decoded, value, own)
        if match.some:
            out = out & reduce(
                lambda a, b: a | b, [self._test(t, decoded, value, own) for t in match.some]
            )
        return F.coalesce(out, F.lit(False))

    def _calibrated(self, f: Field, decoded: dict[str, Field], value: Value) -> Column:
        """The first context that matches, else the default calibrator, else the raw number."""
        number = value(f).cast("double")
        out = calibrate(f.kind.default, number) if f.kind.default else number
        for match, calibrator in reversed(f.kind.contexts):
            fits = self._matches(match, decoded, value, f)
            out = F.when(fits, calibrate(calibrator, number)).otherwise(out)
        return out

    def _before(self, fields: list[Field], index: int) -> dict[str, Field]:
        return {f.name: f for f in fields[:index]}

    # ------------------------------------------------------------------ packets

    def match(self, packets: DataFrame) -> DataFrame:
        """Add ``container`` and ``reason``: exactly one description has to fit."""
        # Fields criteria look at are read once per packet, however many containers ask.
        columns: dict[tuple, str] = {}

        def value(f: Field) -> Column:
            name = columns.setdefault((f.offset, f.kind.size, f.kind.encoding), f"_k{len(columns)}")
            reads.setdefault(name, self._number(f))
            return F.col(name)

        reads: dict[str, Column] = {}
        fits = {}
        for name in self.concrete:
            held = {f.name: f for f in self.fields(name)}
            seen: dict[str, Field] = {}
            test = F.lit(True)
            for part in self._chain(name):
                test = test & self._matches(self.definition.containers[part].criteria, dict(seen), value)
                for parameter in self._entries(part):
                    seen[parameter] = held[parameter]
            fits[name] = test
        # A container gives way to one that inherits from it and fits as well.
        chosen = {}
        for name in self.concrete:
            test = fits[name]
            for other in self.concrete:
                if other != name and name in self._chain(other):
                    test = test & ~fits[other]
            chosen[name] = test
        counts = [F.when(test, 1).otherwise(0) for test in chosen.values()]
        found = {
            "_fits": reduce(lambda a, b: a + b, counts),
            "container": F.coalesce(*[F.when(test, F.lit(name)) for name, test in chosen.items()]),
        }
        read = staged(packets, reads) if reads else packets
        refusal = F.when(F.col("_fits") == 0, REFUSALS["unrecognized"]).when(
            F.col("_fits") > 1, REFUSALS["ambiguous"]
        )
        judged = staged(read, found).drop(*reads)
        return judged.withColumns(
            {"container": F.when(F.col("_fits") == 1, F.col("container")), "reason": refusal}
        ).drop("_fits")

    def _per_container(self, make, among: Sequence[str] | None = None) -> Column:
        """``make(name)`` for the packet's own container; the other branches are not evaluated."""
        out = None
        for name in among or self.concrete:
            mine = F.col("container") == name
            out = F.when(mine, make(name)) if out is None else out.when(mine, make(name))
        return out

    def _needed(self, name: str, wanted: set[str], strict: bool) -> list[tuple[int, Field]]:
        """Fields of a container to be read, with their places: those wanted, those that contexts of
        these look at, and with ``strict`` all that may refuse a packet."""
        fields = self.fields(name)
        place = {f.name: i for i, f in enumerate(fields)}
        out: set[str] = set()

        def add(f: Field) -> None:
            if f.name in out:
                return
            out.add(f.name)
            for match, _ in f.kind.contexts:
                for test in (*match.every, *match.some):
                    if place.get(test.parameter, len(fields)) < place[f.name]:
                        add(fields[place[test.parameter]])

        for f in fields:
            if f.name in wanted or (strict and (f.kind.kind in ("enumerated", "string") or _is_calibrated(f))):
                add(f)
        return [(i, f) for i, f in enumerate(fields) if f.name in out]

    def decode(
        self,
        packets: DataFrame,
        clock: Clock | None = None,
        wanted: Sequence[str] | None = None,
        *,
        strict: bool = True,
        form: Callable[[Column], Column] | None = None,
    ) -> DataFrame:
        """Packets with container, reason, trailing_bits, spacecraft time, time and samples.

        ``wanted`` names the parameters to decode (leaf or qualified names; all by default): nothing
        else is read from a packet but what decides about it.  A packet is refused for any of its
        fields; without ``strict`` only for those read.  ``form`` is what samples hold of a value, raw
        or not; by default they hold the tagged value itself.

        A refused packet keeps its row, with a reason and no samples.  ``time`` is the
        spacecraft's where the clock parameter gives one, else that of receipt, in nanoseconds.

        The stages are stacked projections (octets, numbers, calibrated numbers, refusal,
        samples), so that no field is read twice.
        """
        if clock is not None and clock.parameter not in self.definition.types:
            raise ValueError(f"the definition declares no parameter named {clock.parameter!r}")
        prefix = self.definition.qualified("")
        asked = set(self.definition.types if wanted is None else [w.removeprefix(prefix) for w in wanted])
        unknown = sorted(asked - set(self.definition.types))
        if unknown:
            raise ValueError(f"the definition declares no parameter named {unknown[0]!r}")
        read = asked | ({clock.parameter} if clock is not None else set())
        placed = {name: self._needed(name, read, strict) for name in self.concrete}
        layouts = {name: [f for _, f in fields] for name, fields in placed.items()}
        bearing = [name for name in self.concrete if any(f.name in asked for f in layouts[name])]
        if not bearing:
            raise ValueError("no packet carries any of the parameters asked for")
        wide = any(_is_wide(f) for fields in layouts.values() for f in fields)
        whole_type = "decimal(20,0)" if wide else "bigint"

        def values_of(name: str) -> Value:
            index = {f: i for i, f in enumerate(layouts[name])}
            return lambda f: F.get("_reals" if f.kind.ieee else "_wholes", F.lit(index[f]))

        def numbers(name: str, real: bool, to: str) -> Column:
            each = [
                self._number(f).cast(to) if _is_number(f) and f.kind.ieee == real else F.lit(None).cast(to)
                for f in layouts[name]
            ]
            return F.array(*each).cast(f"array<{to}>")

        matched = self.match(packets)
        size = F.length(self.octets).cast("bigint") * 8
        described = self._per_container(lambda n: F.lit(self.described_bits(n)))
        short = size < described
        stage = staged(
            matched,
            {
                "reason": F.when(short, REFUSALS["short_field"]).otherwise(F.col("reason")),
                "trailing_bits": size - described,
                "_wholes": self._per_container(lambda n: numbers(n, False, whole_type)),
                "_reals": self._per_container(lambda n: numbers(n, True, "double"))
                if any(f.kind.ieee for fields in layouts.values() for f in fields)
                else F.array().cast("array<double>"),
            },
        )

        def engineering(name: str) -> Column:
            fields, value = layouts[name], values_of(name)
            return F.array(
                *[
                    self._calibrated(f, self._before(fields, i), value)
                    if _is_calibrated(f)
                    else F.lit(None).cast("double")
                    for i, f in enumerate(fields)
                ]
            ).cast("array<double>")

        def labels(name: str) -> Column:
            value = values_of(name)
            return F.array(
                *[
                    self._label(f, value(f)) if f.kind.kind == "enumerated" else F.lit(None).cast("string")
                    for f in layouts[name]
                ]
            ).cast("array<string>")

        stage = staged(
            stage,
            {"_eng": self._per_container(engineering), "_labels": self._per_container(labels)},
        )

        def refusal(name: str) -> Column:
            """The first field, in order, that cannot be decoded."""
            out = F.lit(None).cast("string")
            for i, f in reversed(list(enumerate(layouts[name]))):
                if f.kind.kind == "enumerated":
                    out = F.when(F.get("_labels", F.lit(i)).isNull(), REFUSALS["enumeration"]).otherwise(out)
                elif _is_calibrated(f):
                    out = F.when(F.get("_eng", F.lit(i)).isNull(), REFUSALS["calibration"]).otherwise(out)
                elif f.kind.kind == "string":
                    valid = F.is_valid_utf8(self._octets(f).cast("string"))
                    out = F.when(~valid, REFUSALS["text"]).otherwise(out)
            return out

        stage = staged(
            stage, {"reason": F.coalesce(F.col("reason"), self._per_container(refusal))}
        )

        def sample(i: int, ordinal: int, f: Field, value: Value) -> Column:
            raw = self._raw_value(f, value)
            formed = form or (lambda v: v)
            return F.struct(
                F.lit(ordinal).alias("ordinal"),
                F.lit(self.definition.qualified(f.name)).alias("parameter"),
                formed(raw).alias("raw"),
                formed(self._eng_value(i, f, value, raw)).alias("eng"),
            )

        def samples(name: str) -> Column:
            value = values_of(name)
            return F.array(*[sample(i, at, f, value) for i, (at, f) in enumerate(placed[name]) if f.name in asked])

        def stamp(name: str) -> Column:
            for i, f in enumerate(layouts[name]):
                if clock is not None and f.name == clock.parameter:
                    value = values_of(name)
                    number = F.get("_eng", F.lit(i)) if _is_calibrated(f) else F.lit(None).cast("double")
                    if _is_number(f) and not _is_calibrated(f) and f.kind.kind != "enumerated":
                        number = value(f).cast("double")
                    raw = self._raw_value(f, value)
                    return timecode.from_value(clock.code, raw, number, **dict(clock.layout))
            return F.lit(None).cast("bigint")

        fine = F.col("reason").isNull()
        return (
            stage.withColumns(
                {
                    "spacecraft": F.when(fine, self._per_container(stamp)),
                    "samples": F.when(fine, self._per_container(samples, bearing)),
                    "container": F.when(fine, F.col("container")),
                    "trailing_bits": F.when(fine, F.col("trailing_bits")),
                }
            )
            .drop("_wholes", "_reals", "_eng", "_labels")
            .withColumn("time", F.coalesce("spacecraft", "received_ns"))
        )

    def _raw_value(self, f: Field, value: Value) -> Column:
        if not _is_number(f):
            return value_struct("Bytes", x=self._octets(f))
        if f.kind.ieee:
            return value_struct("Float", f=value(f))
        signed = f.kind.encoding in ("twosComplement", "signed")
        return value_struct("Signed" if signed else "Unsigned", i=value(f))

    def _eng_value(self, i: int, f: Field, value: Value, raw: Column) -> Column:
        if f.kind.kind == "enumerated":
            return value_struct("Label", s=F.get("_labels", F.lit(i)))
        if f.kind.kind == "boolean":
            return value_struct("Bool", b=value(f) != 0)
        if f.kind.kind == "string":
            return value_struct("Text", s=F.try_validate_utf8(self._octets(f).cast("string")))
        if _is_calibrated(f):
            return value_struct("Float", f=F.get("_eng", F.lit(i)))
        return raw


def explode_samples(decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: one row per decoded value, all stamped with the packet's time."""
    return decoded.filter(F.col("reason").isNull()).select(
        *keys, "container", "time", "spacecraft", F.inline("samples")
    )


def reject_tally(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("packets")
    )


def undescribed(decoded: DataFrame, order: str = "pkt_no") -> DataFrame:
    """First packet of each container that is longer than its description."""
    longer = decoded.filter(F.col("trailing_bits") > 0)
    return longer.groupBy("container").agg(
        F.min(order).alias(order), F.min_by("trailing_bits", order).alias("trailing_bits")
    )


def header_observation(packets: DataFrame) -> DataFrame:
    """Last receipt and packets with a readable header; refused and cut-off ones still arrived."""
    return packets.agg(
        F.max("received").alias("last_packet"),
        F.count(F.lit(1)).alias("arrived"),
        F.count("apid").alias("with_header"),
    )
