"""The definition of the packets :mod:`passband.fixtures.views` builds, as mission XML."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from passband.session import shared_folder

LABELS = ("VIEW", "CLICK", "SIGNUP", "PURCHASE", "ERROR")
#: Spline of the PURCHASE context: (raw, calibrated).
SPLINE = ((0.0, 5.0), (9000.0, 50.0), (30000.0, 260.0))


def _terms(*terms: tuple[float, int]) -> str:
    each = "".join(f'<Term coefficient="{c}" exponent="{e}"/>' for c, e in terms)
    return f"<PolynomialCalibrator>{each}</PolynomialCalibrator>"


def _context(test: str, calibrator: str) -> str:
    return (
        f"<ContextCalibrator><ContextMatch><Comparison {test}/></ContextMatch>"
        f"<Calibrator>{calibrator}</Calibrator></ContextCalibrator>"
    )


def _integer(name: str, size: int, inside: str = "", unit: str = "") -> str:
    units = f"<UnitSet><Unit>{unit}</Unit></UnitSet>" if unit else "<UnitSet/>"
    return (
        f'<IntegerParameterType name="{name}" signed="false">{units}'
        f'<IntegerDataEncoding sizeInBits="{size}" encoding="unsigned">{inside}</IntegerDataEncoding>'
        "</IntegerParameterType>"
    )


def _enumerated(name: str, labels: tuple[str, ...]) -> str:
    each = "".join(f'<Enumeration value="{i}" label="{l}"/>' for i, l in enumerate(labels))
    return (
        f'<EnumeratedParameterType name="{name}"><UnitSet/>'
        '<IntegerDataEncoding sizeInBits="8" encoding="unsigned"/>'
        f"<EnumerationList>{each}</EnumerationList></EnumeratedParameterType>"
    )


def _container(name: str, entries: tuple[str, ...], criteria: str = "", abstract: bool = False) -> str:
    refs = "".join(f'<ParameterRefEntry parameterRef="{e}"/>' for e in entries)
    base = (
        f'<BaseContainer containerRef="Header"><RestrictionCriteria>{criteria}'
        "</RestrictionCriteria></BaseContainer>"
        if criteria
        else ""
    )
    flag = ' abstract="true"' if abstract else ""
    return f'<SequenceContainer name="{name}"{flag}><EntryList>{refs}</EntryList>{base}</SequenceContainer>'


def _apid(operator: str, value: int) -> str:
    return (
        f'<Comparison parameterRef="APID" comparisonOperator="{operator}" value="{value}" '
        'useCalibratedValue="false"/>'
    )


def text() -> str:
    """Two packet types by APID, a gap between them, and an overlap that is ambiguous."""
    points = "".join(f'<SplinePoint raw="{r}" calibrated="{c}"/>' for r, c in SPLINE)
    contexts = (
        "<ContextCalibratorList>"
        + _context('parameterRef="MODE" value="4" useCalibratedValue="false"', _terms((0.0075, 1), (3.5, 0)))
        + _context('parameterRef="MODE" value="0" useCalibratedValue="false"', _terms((-0.015, 1)))
        + _context(
            'parameterRef="MODE" value="PURCHASE"',
            f'<SplineCalibrator order="1" extrapolate="true">{points}</SplineCalibrator>',
        )
        + "</ContextCalibratorList><DefaultCalibrator>"
        + _terms((0.01, 1), (40.0, 0))
        + "</DefaultCalibrator>"
    )
    types = (
        "".join(_integer(f"U{n}", n) for n in (1, 2, 3, 11, 14, 16))
        + _enumerated("MODE_T", LABELS)
        + _enumerated("SHORT_MODE_T", LABELS[:4])
        + _integer("RAW_T", 32, contexts, "mV")
    )
    declared = {
        "VERSION": "U3", "TYPE": "U1", "SECONDARY": "U1", "APID": "U11", "FLAGS": "U2",
        "COUNT": "U14", "LENGTH": "U16", "MODE": "MODE_T", "RAW": "RAW_T",
        "SHORT_MODE": "SHORT_MODE_T", "RAW_HIGH": "U16", "SPARE": "U16",
    }
    parameters = "".join(
        f'<Parameter name="{n}" parameterTypeRef="{t}"/>' for n, t in declared.items()
    )
    header = ("VERSION", "TYPE", "SECONDARY", "APID", "FLAGS", "COUNT", "LENGTH")
    containers = (
        _container("Header", header, abstract=True)
        + _container("Low", ("MODE", "RAW"), _apid("&lt;", 100))
        + _container("High", ("SHORT_MODE", "RAW_HIGH"), _apid("&gt;=", 130))
        + _container(
            "Overlap",
            ("MODE",),
            f"<ComparisonList>{_apid('&gt;=', 140)}{_apid('&lt;=', 145)}</ComparisonList>",
        )
    )
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<SpaceSystem name="Mission"><TelemetryMetaData>'
        f"<ParameterTypeSet>{types}</ParameterTypeSet><ParameterSet>{parameters}</ParameterSet>"
        f"<ContainerSet>{containers}</ContainerSet></TelemetryMetaData></SpaceSystem>\n"
    )


def publish(spark: SparkSession, content: str, name: str, suffix: str) -> str:
    """Write a small configuration text where every executor can read it; returns the path."""
    path = f"{shared_folder(spark)}/passband-{name}-{uuid.uuid4().hex}.{suffix}"
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return path
