"""Mission definitions: XML to dimension tables, and the tables to a layout for compilation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CALIBRATOR = (
    "struct<PolynomialCalibrator:struct<Term:array<struct<_coefficient:double,_exponent:int>>>,"
    "SplineCalibrator:struct<_order:int,_extrapolate:boolean,"
    "SplinePoint:array<struct<_raw:double,_calibrated:double>>>>"
)
_COMPARISON = "struct<_parameterRef:string,_value:string,_comparisonOperator:string,_useCalibratedValue:boolean>"
_CONDITION = (
    "struct<ParameterInstanceRef:struct<_parameterRef:string,_useCalibratedValue:boolean>,"
    "ComparisonOperator:string,Value:string>"
)
_MATCH = (
    f"Comparison:array<{_COMPARISON}>,ComparisonList:struct<Comparison:array<{_COMPARISON}>>,"
    f"BooleanExpression:struct<Condition:{_CONDITION},"
    f"ANDedConditions:struct<Condition:array<{_CONDITION}>>,"
    f"ORedConditions:struct<Condition:array<{_CONDITION}>>>"
)
_ENCODING = (
    f"struct<_sizeInBits:int,_encoding:string,DefaultCalibrator:{_CALIBRATOR},"
    f"ContextCalibratorList:struct<ContextCalibrator:array<struct<ContextMatch:struct<{_MATCH}>,"
    f"Calibrator:{_CALIBRATOR}>>>>"
)
_SIZED = "struct<SizeInBits:struct<FixedValue:int,Fixed:struct<FixedValue:int>>>"
TYPE_SCHEMA = (
    f"_name string, UnitSet struct<Unit:array<string>>, IntegerDataEncoding {_ENCODING}, "
    f"FloatDataEncoding {_ENCODING}, BinaryDataEncoding {_SIZED}, StringDataEncoding {_SIZED}, "
    "EnumerationList struct<Enumeration:array<struct<_value:bigint,_label:string>>>"
)
CONTAINER_SCHEMA = (
    "_name string, _abstract boolean, EntryList string, "
    f"BaseContainer struct<_containerRef:string,RestrictionCriteria:struct<{_MATCH}>>"
)
TYPE_TAGS = {
    "IntegerParameterType": "integer",
    "FloatParameterType": "float",
    "EnumeratedParameterType": "enumerated",
    "BooleanParameterType": "boolean",
    "BinaryParameterType": "binary",
    "StringParameterType": "string",
}
_ENTRY = r'<(?:[\w.-]+:)?(ParameterRefEntry|ContainerRefEntry)\b[^>]*?(?:parameterRef|containerRef)\s*=\s*"([^"]*)"'


@dataclass(frozen=True)
class DefinitionTables:
    """Dimension tables of one definition."""

    system: str
    parameters: DataFrame  # parameter (qualified), name, type, ordinal-free
    types: DataFrame  # type, kind, size, encoding, units, enumeration, calibrators
    containers: DataFrame  # container, abstract, entries, base, criteria


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .schema(schema)
        .option("rowTag", tag)
        .option("ignoreNamespace", True)
        .load(path)
    )


def scan(spark: SparkSession, path: str) -> DefinitionTables:
    """Read a definition file; namespaced and plain element names are the same here."""
    roots = _read(spark, path, "SpaceSystem", "_name string, SpaceSystem array<struct<_name:string>>").head(2)
    if len(roots) != 1:
        raise ValueError(f"{path}: expected one SpaceSystem, found {len(roots)}")
    if roots[0].SpaceSystem:
        raise ValueError(f"{path}: nested SpaceSystem elements are not supported")
    system = roots[0]._name
    parameters = _read(spark, path, "Parameter", "_name string, _parameterTypeRef string").select(
        F.concat(F.lit(f"/{system}/"), "_name").alias("parameter"),
        F.col("_name").alias("leaf"),
        F.lit(f"/{system}").alias("space_system"),
        F.col("_parameterTypeRef").alias("type"),
        # the reader goes through a document from front to back, so row numbers keep its order
        F.monotonically_increasing_id().alias("declared"),
    )
    types = None
    for tag, kind in TYPE_TAGS.items():
        encoding = F.coalesce("IntegerDataEncoding", "FloatDataEncoding")
        sized = F.coalesce("BinaryDataEncoding", "StringDataEncoding")
        rows = _read(spark, path, tag, TYPE_SCHEMA).select(
            F.col("_name").alias("type"),
            F.lit(kind).alias("kind"),
            F.col("FloatDataEncoding").isNotNull().alias("ieee"),
            F.coalesce(
                encoding["_sizeInBits"],
                sized["SizeInBits"]["FixedValue"],
                sized["SizeInBits"]["Fixed"]["FixedValue"],
            ).alias("size"),
            encoding["_encoding"].alias("encoding"),
            F.coalesce(F.col("UnitSet.Unit"), F.array().cast("array<string>")).alias("units"),
            F.col("EnumerationList.Enumeration").alias("enumeration"),
            encoding["DefaultCalibrator"].alias("default_calibrator"),
            encoding["ContextCalibratorList"]["ContextCalibrator"].alias("context_calibrators"),
        )
        types = rows if types is None else types.unionByName(rows)
    containers = _read(spark, path, "SequenceContainer", CONTAINER_SCHEMA).select(
        F.col("_name").alias("container"),
        F.coalesce("_abstract", F.lit(False)).alias("abstract"),
        F.arrays_zip(
            F.regexp_extract_all("EntryList", F.lit(_ENTRY), 1).alias("entry"),
            F.regexp_extract_all("EntryList", F.lit(_ENTRY), 2).alias("ref"),
        ).alias("entries"),
        F.col("BaseContainer._containerRef").alias("base"),
        F.col("BaseContainer.RestrictionCriteria").alias("criteria"),
    )
    return DefinitionTables(system, parameters, types, containers)


def parameter_table(tables: DefinitionTables) -> DataFrame:
    """Names, units and plottability per parameter, for the lookups of the value jobs."""
    kinds = tables.types.select("type", "kind", "units", "ieee")
    return tables.parameters.join(kinds, "type", "left").select(
        "parameter",
        "leaf",
        "space_system",
        "units",
        F.col("kind").isin("integer", "float", "boolean").alias("plottable"),
        "declared",
    )


def enumeration_table(tables: DefinitionTables) -> DataFrame:
    return tables.types.select("type", F.inline("enumeration")).select(
        "type", F.col("_value").alias("raw"), F.col("_label").alias("label")
    )


def container_entry_table(tables: DefinitionTables) -> DataFrame:
    return tables.containers.select("container", F.posexplode("entries").alias("ordinal", "_e")).select(
        "container", "ordinal", "_e.*"
    )


# ------------------------------------------------------------------------------ compiled layout


@dataclass(frozen=True)
class Test:
    """One comparison of a criterion."""

    parameter: str
    operator: str
    value: str
    calibrated: bool


@dataclass(frozen=True)
class Match:
    """All of ``every`` and, where there is any, one of ``some``."""

    every: tuple[Test, ...] = ()
    some: tuple[Test, ...] = ()


@dataclass(frozen=True)
class Calibrator:
    terms: tuple[tuple[float, int], ...] = ()
    points: tuple[tuple[float, float], ...] = ()
    order: int = 1
    extrapolate: bool = False


@dataclass(frozen=True)
class ParameterType:
    kind: str
    size: int
    encoding: str
    ieee: bool
    labels: tuple[tuple[int, str], ...] = ()
    default: Calibrator | None = None
    contexts: tuple[tuple[Match, Calibrator], ...] = ()


@dataclass(frozen=True)
class Container:
    name: str
    abstract: bool
    entries: tuple[tuple[str, str], ...]
    base: str | None
    criteria: Match


@dataclass
class Definition:
    """A definition small enough to be part of a query: it becomes column expressions."""

    system: str
    types: dict[str, ParameterType] = field(default_factory=dict)  # by parameter name
    containers: dict[str, Container] = field(default_factory=dict)

    def qualified(self, name: str) -> str:
        return f"/{self.system}/{name}"


def _match(row) -> Match:
    if row is None:
        return Match()

    def comparison(c) -> Test:
        calibrated = True if c._useCalibratedValue is None else c._useCalibratedValue
        return Test(c._parameterRef, c._comparisonOperator or "==", c._value, calibrated)

    def condition(c) -> Test:
        ref = c.ParameterInstanceRef
        calibrated = True if ref._useCalibratedValue is None else ref._useCalibratedValue
        return Test(ref._parameterRef, (c.ComparisonOperator or "==").strip(), (c.Value or "").strip(), calibrated)

    every = [comparison(c) for c in row.Comparison or []]
    if row.ComparisonList is not None:
        every += [comparison(c) for c in row.ComparisonList.Comparison or []]
    some: list[Test] = []
    expression = row.BooleanExpression
    if expression is not None:
        if expression.Condition is not None:
            every.append(condition(expression.Condition))
        if expression.ANDedConditions is not None:
            every += [condition(c) for c in expression.ANDedConditions.Condition or []]
        if expression.ORedConditions is not None:
            some += [condition(c) for c in expression.ORedConditions.Condition or []]
    return Match(tuple(every), tuple(some))


def _calibrator(row) -> Calibrator | None:
    if row is None:
        return None
    if row.PolynomialCalibrator is not None:
        return Calibrator(terms=tuple((t._coefficient, t._exponent) for t in row.PolynomialCalibrator.Term))
    if row.SplineCalibrator is not None:
        spline = row.SplineCalibrator
        points = tuple(sorted((p._raw, p._calibrated) for p in spline.SplinePoint))
        order = 0 if spline._order is None else spline._order
        return Calibrator(points=points, order=order, extrapolate=bool(spline._extrapolate))
    return None


def compile_definition(tables: DefinitionTables) -> Definition:
    """Bring a definition to the driver.  It is metadata: thousands of rows, whatever the data."""
    types = {}
    for row in tables.types.collect():
        types[row.type] = ParameterType(
            row.kind,
            row.size,
            row.encoding or ("IEEE754" if row.ieee else "unsigned"),
            row.ieee,
            tuple((e._value, e._label) for e in row.enumeration or []),
            _calibrator(row.default_calibrator),
            tuple(
                (_match(c.ContextMatch), _calibrator(c.Calibrator)) for c in row.context_calibrators or []
            ),
        )
    out = Definition(tables.system)
    for row in tables.parameters.collect():
        if row.type not in types:
            raise ValueError(f"parameter {row.parameter} has an unknown type {row.type}")
        out.types[row.leaf] = types[row.type]
    for row in tables.containers.collect():
        out.containers[row.container] = Container(
            row.container,
            row.abstract,
            tuple(("container" if e.entry == "ContainerRefEntry" else "parameter", e.ref) for e in row.entries or []),
            row.base,
            _match(row.criteria),
        )
    return out
