"""Definitions, documents, exports, series and streams on small fixtures."""

import math
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from passband.operators import decommutate, series, simplify, store
from passband.session import shared_folder
from passband.fixtures import mission
from passband.sources import definition, documents, exports
from passband.streaming import status

def line(*terms):
    """A polynomial calibrator of (coefficient, exponent) terms."""
    return "<PolynomialCalibrator>" + "".join(f'<Term coefficient="{c}" exponent="{e}"/>' for c, e in terms) + "</PolynomialCalibrator>"


def when(test, calibrator):
    return f"<ContextCalibrator><ContextMatch><Comparison {test}/></ContextMatch><Calibrator>{calibrator}</Calibrator></ContextCalibrator>"


def unsigned(name, bits, contexts="", default="", units=()):
    listed = "".join(f"<Unit>{u}</Unit>" for u in units)
    inside = (f"<DefaultCalibrator>{default}</DefaultCalibrator>" if default else "") + (
        f"<ContextCalibratorList>{contexts}</ContextCalibratorList>" if contexts else ""
    )
    return f'<IntegerParameterType name="{name}"><UnitSet>{listed}</UnitSet><IntegerDataEncoding sizeInBits="{bits}">{inside}</IntegerDataEncoding></IntegerParameterType>'


def container(name, refs, base=""):
    each = "".join(f'<{"ContainerRefEntry containerRef" if r.startswith("@") else "ParameterRefEntry parameterRef"}="{r.lstrip("@")}"/>' for r in refs)
    return f'<SequenceContainer name="{name}"{"" if base else " abstract=\'true\'"}><EntryList>{each}</EntryList>{base}</SequenceContainer>'


#: An oven: its warmth by state, a damper that is calibrated by a field yet to come, and a flow curve.
OVEN_PARAMETERS = {"KIND": "K24", "STATE": "STATE_T", "WARMTH": "WARMTH_T", "DAMPER": "DAMPER_T", "FLOW": "FLOW_T", "DOOR": "B8", "VOLTS": "REAL"}
OVEN = (
    '<SpaceSystem name="Oven"><TelemetryMetaData><ParameterTypeSet>'
    + unsigned("K24", 24, units=("lot", "no"))
    + unsigned("B8", 8)
    + '<EnumeratedParameterType name="STATE_T"><UnitSet/><IntegerDataEncoding sizeInBits="8"/><EnumerationList>'
    + "".join(f'<Enumeration value="{v}" label="{n}"/>' for v, n in ((1, "COLD"), (6, "BAKE"), (9, "VENT")))
    + "</EnumerationList></EnumeratedParameterType>"
    + unsigned("WARMTH_T", 24, when('parameterRef="STATE" value="6" useCalibratedValue="false"', line((0.125, 1), (-3.0, 0), (2.0, 2))), line((3.0, 1), (7.0, 0)))
    + unsigned("DAMPER_T", 8, when('parameterRef="DOOR" value="33" useCalibratedValue="false"', line((1.5, 0))), line((10.0, 1)))
    + unsigned(
        "FLOW_T",
        16,
        when(
            'parameterRef="STATE" value="VENT"',
            '<SplineCalibrator order="1" extrapolate="true">'
            + "".join(f'<SplinePoint raw="{r}" calibrated="{c}"/>' for r, c in ((10, 1.0), (20, 3.0), (60, 11.0), (100, 9.0)))
            + "</SplineCalibrator>",
        ),
        line((0.75, 1)),
    )
    + '<FloatParameterType name="REAL"><UnitSet/><FloatDataEncoding sizeInBits="32"/></FloatParameterType>'
    + "</ParameterTypeSet><ParameterSet>"
    + "".join(f'<Parameter name="{n}" parameterTypeRef="{t}"/>' for n, t in OVEN_PARAMETERS.items())
    + "</ParameterSet><ContainerSet>"
    + container("Front", ["KIND"])
    + container("Rear", ["DOOR", "VOLTS"])
    + container(
        "Report",
        ["STATE", "WARMTH", "DAMPER", "FLOW", "@Rear"],
        '<BaseContainer containerRef="Front"><RestrictionCriteria><BooleanExpression><Condition>'
        '<ParameterInstanceRef parameterRef="KIND" useCalibratedValue="false"/><ComparisonOperator>==</ComparisonOperator><Value>70001</Value>'
        "</Condition></BooleanExpression></RestrictionCriteria></BaseContainer>",
    )
    + "</ContainerSet></TelemetryMetaData></SpaceSystem>"
)


def test_calibration_contexts(spark):
    tables = definition.scan(spark, mission.publish(spark, OVEN, "oven", "xml"))
    units = {r.leaf: r.units for r in definition.parameter_table(tables).collect()}
    assert units["KIND"] == ["lot", "no"] and units["STATE"] == []
    decoder = decommutate.Decommutator(definition.compile_definition(tables))
    assert [f.name for f in decoder.fields("Report")] == list(OVEN_PARAMETERS)

    def packet(kind, state, warmth, damper, flow, door):
        words = ((kind, 3), (state, 1), (warmth, 3), (damper, 1), (flow, 2), (door, 1))
        return bytearray(b"".join(w.to_bytes(n, "big") for w, n in words) + struct.pack(">f", -1.25))

    rows = {
        "cold": packet(70001, 1, 90000, 33, 8, 0), "bake": packet(70001, 6, 16, 4, 8, 33), "vent": packet(70001, 9, 1, 4, 40, 33),
        "beyond": packet(70001, 9, 1, 4, 120, 33) + b"\7\7\7", "other": packet(70002, 1, 0, 0, 0, 0), "no such state": packet(70001, 2, 0, 0, 0, 0),
        "short": packet(70001, 1, 0, 0, 0, 0)[:11],
    }
    df = spark.createDataFrame([(i, b, 9) for i, b in enumerate(rows.values())], "pkt_no bigint, bytes binary, received_ns bigint")
    out = dict(zip(rows, sorted(decoder.decode(df).collect(), key=lambda r: r.pkt_no)))
    assert out["other"].reason == "packet type not described" and out["other"].samples is None
    assert out["no such state"].reason == "value outside its enumeration"
    assert out["short"].reason == "field past the end of the packet"

    def eng(name):
        return {s.parameter.rsplit("/", 1)[1]: s.eng for s in out[name].samples}

    # 3 * 90000 + 7; DOOR is not known yet where DAMPER stands, so its own number is compared
    assert eng("cold")["WARMTH"].f == 270007.0 and eng("cold")["STATE"].s == "COLD" and eng("cold")["DAMPER"].f == 1.5
    # 2 * 16 * 16 + 16 / 8 - 3; 3 / 4 of 8
    assert eng("bake")["WARMTH"].f == 511.0 and eng("bake")["DAMPER"].f == 40.0 and eng("bake")["FLOW"].f == 6.0
    # halfway from 3 to 11; past the last point along the last slope of -1 / 20
    assert eng("vent")["FLOW"].f == 7.0 and eng("beyond")["FLOW"].f == 8.0
    assert eng("vent")["VOLTS"].f == -1.25 and eng("vent")["VOLTS"].kind == "Float"
    assert eng("bake")["DOOR"].kind == "Unsigned" and out["beyond"].trailing_bits == 24
    with pytest.raises(ValueError):
        decoder.decode(df, decommutate.Clock("NOPE", "cuc"))

    # only what is asked for is decoded: the same samples, the same refusals, fewer fields read
    whole = {r.pkt_no: r for r in out.values()}
    for wanted in (["VOLTS"], ["/Oven/WARMTH", "DOOR"], ["KIND", "DAMPER"]):
        names = {w.rsplit("/", 1)[-1] for w in wanted}
        for r in decoder.decode(df, wanted=wanted).collect():
            full = whole[r.pkt_no]
            assert (r.reason, r.container, r.trailing_bits) == (full.reason, full.container, full.trailing_bits)
            assert (r.samples or []) == [s for s in full.samples or [] if s.parameter.rsplit("/", 1)[1] in names]
    reads = lambda d: d._jdf.queryExecution().analyzed().toString().count("substring")
    one = decoder.decode(df, wanted=["VOLTS"], strict=False)
    assert reads(one) < reads(decoder.decode(df, wanted=["VOLTS"])) < reads(decoder.decode(df))
    loose = {r.pkt_no: r.reason for r in one.collect()}
    assert loose[list(rows).index("no such state")] is None
    with pytest.raises(ValueError):
        decoder.decode(df, wanted=["NOPE"])


def test_text_that_is_none(spark):
    types = (
        unsigned("B8", 8)
        + '<StringParameterType name="NAME_T"><UnitSet/><StringDataEncoding><SizeInBits><Fixed><FixedValue>24</FixedValue></Fixed></SizeInBits></StringDataEncoding></StringParameterType>'
    )
    base = '<BaseContainer containerRef="Front"><RestrictionCriteria><Comparison parameterRef="KIND" value="4" useCalibratedValue="false"/></RestrictionCriteria></BaseContainer>'
    text = (
        f'<SpaceSystem name="Names"><TelemetryMetaData><ParameterTypeSet>{types}</ParameterTypeSet><ParameterSet>'
        '<Parameter name="KIND" parameterTypeRef="B8"/><Parameter name="NAME" parameterTypeRef="NAME_T"/></ParameterSet><ContainerSet>'
        + container("Front", ["KIND"]) + container("Call", ["NAME"], base) + "</ContainerSet></TelemetryMetaData></SpaceSystem>"
    )
    decoder = decommutate.Decommutator(definition.compile_definition(definition.scan(spark, mission.publish(spark, text, "names", "xml"))))
    rows = [(0, bytearray(b"\x04abc"), 9), (1, bytearray(b"\x04a\xff\xfe"), 9), (2, bytearray("\x04éa".encode()), 9)]
    out = {r.pkt_no: r for r in decoder.decode(spark.createDataFrame(rows, "pkt_no bigint, bytes binary, received_ns bigint")).collect()}
    assert out[1].reason == "invalid text" and out[1].samples is None
    assert [out[i].samples[1].eng.s for i in (0, 2)] == ["abc", "éa"]


def write(spark, text, name):
    return mission.publish(spark, text, name, "json")


def test_limits_file(spark):
    plain = '{"/Sat/TEMP": {"warning_low": -10, "alarm_high": 70.5}, "B": {}}'
    for text in (plain, '{"parameters": %s}' % plain):
        got = {r.parameter: r for r in documents.limits(spark, write(spark, text, "limits")).collect()}
        assert got["/Sat/TEMP"].warning_low == -10.0 and got["/Sat/TEMP"].alarm_high == 70.5
        assert got["/Sat/TEMP"].alarm_low is None and got["B"].warning_low is None
    for bad in ('{"A": {"warning_lo": 1}}', '{"parameters": {}, "extra": 1}', "[1]"):
        with pytest.raises(ValueError):
            documents.limits(spark, write(spark, bad, "limits")).collect()


def test_watch_list(spark):
    good = '{"version": 1, "watched": ["/A/X"], "plots": [{"title": "t", "parameters": ["/A/X", "Y"], "height": 1.0, "autoscale": true, "y_range": null}]}'
    watched, plots = documents.watch_list(spark, write(spark, good, "watch"))
    assert [r.name for r in watched.collect()] == ["/A/X"]
    assert sorted((r.plot_no, r.ordinal, r.name) for r in plots.collect()) == [(0, 0, "/A/X"), (0, 1, "Y")]
    for bad in (good.replace('"version": 1', '"version": 2'), good.replace('"watched"', '"wached"')):
        with pytest.raises(ValueError):
            documents.watch_list(spark, write(spark, bad, "watch"))


def test_csv_quoting(spark):
    values = ['plain', ' keep spaces ', 'a,b', 'say "hi"', 'two\nlines', 'back\\slash']
    place = f"{shared_folder(spark)}/csv-{time.time_ns()}"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    exports.write_csv(df, place)
    text = "".join(r.value for r in spark.read.text(place + "/*.csv", wholetext=True).collect())
    assert text == 'i,v\n0,plain\n1, keep spaces \n2,"a,b"\n3,"say ""hi"""\n4,"two\nlines"\n5,back\\slash\n'


def points(spark, values, step=1.0, key="p"):
    rows = [(key, i, 1.7e9 + i * step, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "parameter string, seq_no bigint, t double, v double")


def test_window_edges(spark):
    df = points(spark, range(10))
    base = 1.7e9

    def picked(low, high):
        return sorted(r.seq_no for r in series.select_window(df, low, high).collect())

    assert picked(base + 3, base + 5) == [2, 3, 4, 5, 6]
    assert picked(base + 3.2, base + 3.4) == [3, 4]
    assert picked(base - 5, base - 1) == [0] and picked(base + 50, base + 60) == [9]
    assert picked(base + 5, base + 3) == [] and picked(float("nan"), base) == [] and len(picked(None, None)) == 10


def kept_by_rdp(t, v, epsilon):
    """Ramer-Douglas-Peucker by recursion over one whole series."""
    x, keep = t - t[0], {0, len(t) - 1}

    def go(a, b):
        if b <= a + 1:
            return
        far = simplify.off_line(x[a + 1 : b], v[a + 1 : b], x[a], v[a], x[b], v[b])
        k = int(np.argmax(far))
        if far[k] > epsilon:
            keep.add(a + 1 + k)
            go(a, a + 1 + k)
            go(a + 1 + k, b)

    go(0, len(t) - 1)
    return sorted(keep)


@pytest.mark.parametrize("threshold,sizes", [(60, {}), (4, {"piece": 7}), (60, {"piece": 7, "slice_points": 1, "width": 64}), (899, {"piece": 50, "slice_points": 40})])
def test_lttb_equals_the_sequential_rule(spark, threshold, sizes):
    rng = random.Random(4)
    values = [math.sin(i / 30) + rng.random() / 10 for i in range(900)]
    values[417] = 50.0
    values[500] = values[501] = float("nan")
    df = points(spark, values)
    t, v = np.array([1.7e9 + i for i in range(900)]), np.array(values)
    whole = sorted(r.seq_no for r in simplify.lttb(df, threshold, **sizes).collect())
    assert whole == series.lttb_indices(t, v, threshold).tolist()
    if threshold == 4:
        assert [simplify.lttb(df, n).count() for n in (2, 0, 901)] == [2, 2, 900]


def test_lttb_of_a_curved_series(spark):
    """Every point is on the hull of its bucket; slices hold a few buckets each."""
    n = 200_000
    df = spark.range(n).select(
        F.lit("p").alias("parameter"), F.col("id").alias("seq_no"), F.col("id").cast("double").alias("t"),
        F.pow(F.col("id") / 1000.0 - 60, 2).alias("v"),
    )
    t = np.arange(n, dtype=float)
    got = sorted(r.seq_no for r in simplify.lttb(df, 100, slice_points=5000).collect())
    assert got == series.lttb_indices(t, np.square(t / 1000 - 60), 100).tolist()


def test_reduction_of_many_series(spark):
    rng = np.random.default_rng(8)
    lengths = [1, 2, 3, 5, 40, 41, 300]
    rows = [(f"s{k}", i, 1.7e9 + i + rng.random() / 2, float(rng.normal())) for k, n in enumerate(lengths) for i in range(n)]
    df = spark.createDataFrame(rows, "parameter string, seq_no bigint, t double, v double")
    few = {r.parameter: r["count"] for r in simplify.lttb(df, 40, slice_points=20).groupBy("parameter").count().collect()}
    assert few == {f"s{k}": min(n, 40) for k, n in enumerate(lengths)}
    got = {}
    for r in simplify.rdp(df, 0.8, block=16).collect():
        got.setdefault(r.parameter, []).append(r.seq_no)
    for k in range(len(lengths)):
        own = np.array([(t, v) for name, _, t, v in rows if name == f"s{k}"])
        assert sorted(got[f"s{k}"]) == kept_by_rdp(own[:, 0], own[:, 1], 0.8)
    assert simplify.lttb(df.limit(0), 40).count() == simplify.rdp(df.limit(0), 1.0).count() == 0


def test_min_max_lttb_keeps_a_spike(spark):
    values = [math.sin(i / 30) for i in range(900)]
    values[417] = 50.0
    df = points(spark, values)
    reduced = sorted(r.seq_no for r in series.min_max_lttb(df, 60, width=64).collect())
    assert len(reduced) == 60 and 417 in reduced
    assert series.min_max_lttb(df, 2).count() == 2 and series.min_max_lttb(df, 1000).count() == 900


@pytest.mark.parametrize("block", [10, 1 << 16])
def test_rdp_over_any_blocks(spark, block):
    rng = random.Random(6)
    values = np.cumsum([rng.choice([-1, 0, 0, 2]) for _ in range(300)])
    t = np.array([1.7e9 + i for i in range(300)])
    got = sorted(r.seq_no for r in simplify.rdp(points(spark, values), 1.5, block=block, width=32).collect())
    assert got == kept_by_rdp(t, values.astype(float), 1.5) and len(got) < 300
    assert simplify.rdp(points(spark, [1, 2]), 0.1, block=block).count() == 2


@pytest.mark.parametrize("span", [1, 3])
def test_rdp_over_any_span(spark, span):
    rng = random.Random(7)
    values = np.cumsum([rng.choice([-1, 0, 0, 2]) for _ in range(100)])
    t = np.array([1.7e9 + i for i in range(100)])
    got = sorted(r.seq_no for r in simplify.rdp(points(spark, values), 1.5, block=16, span=span).collect())
    assert got == kept_by_rdp(t, values.astype(float), 1.5) and len(got) < 100


def test_rdp_of_a_segment_over_few_blocks_starts_no_rounds(spark, monkeypatch):
    """Noise is split dozens of levels deep; over a few blocks that is work of one task."""
    pins, rng = [], random.Random(8)
    real = simplify.pin
    monkeypatch.setattr(simplify, "pin", lambda df: pins.append(1) or real(df))
    values = [rng.random() * 100 for _ in range(200)]
    got = sorted(r.seq_no for r in simplify.rdp(points(spark, values), 60.0, block=50).collect())
    assert got == kept_by_rdp(np.array([1.7e9 + i for i in range(200)]), np.array(values), 60.0) and len(pins) <= 4


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_rdp_with_a_number_that_is_none(spark, block):
    values = [0, 4, 1, 5, 0, float("nan"), 3, 0, 6, 1, 7, 0, 2, 9, 0]
    t = np.array([1.7e9 + i for i in range(15)])
    got = sorted(r.seq_no for r in simplify.rdp(points(spark, values), 1.5, block=block).collect())
    assert got == kept_by_rdp(t, np.array(values, float), 1.5) and 5 not in got


def test_latest_by_packet_then_place(spark):
    rows = [("p", 0, 70_000, 1.0), ("p", 1, 0, 2.0), ("p", 1, 1, 3.0), ("q", 1 << 60, 5, 4.0), ("q", 3, 9, 5.0)]
    df = spark.createDataFrame(rows, "parameter string, pkt_no bigint, ordinal int, eng double")
    got = {r.parameter: (r.eng, r.updates) for r in store.latest(df, ("eng",)).collect()}
    assert got == {"p": (3.0, 3), "q": (4.0, 2)}


def test_places_over_many_partitions(spark):
    rows = [(f"p{i:03d}", i * 7 % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "parameter string, updates int").repartition(9)
    got = [(r.place, r.parameter) for r in store.with_places(df, store.sort_keys("updates")).collect()]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(got) == [(i, name) for i, (name, _) in enumerate(want, 1)]


def test_follow_window_falls_back(spark):
    empty = points(spark, [1.0]).filter("v > 5")
    assert tuple(series.follow_window(empty, F.lit(100.0)).first()) == (40.0, 100.0)
    assert tuple(series.follow_window(points(spark, [1.0]), F.lit(1.0)).first()) == (1.7e9 - 60, 1.7e9)


def test_silence_alarm(spark):
    place = f"{shared_folder(spark)}/silence-{time.time_ns()}"
    spark.createDataFrame([(7, 1)], "capture_id bigint, pkt_no bigint").write.parquet(place + "/in")
    rows = spark.readStream.schema("capture_id bigint, pkt_no bigint").parquet(place + "/in")
    name = f"silence_{time.time_ns()}"
    query = status.silence(rows).writeStream.format("memory").queryName(name).outputMode("update").trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 40
        seen = []
        while time.time() < deadline and "quiet" not in seen:
            time.sleep(1)
            seen = [r.state for r in spark.table(name).orderBy("at_ms").collect()]
        assert seen[:2] == ["live", "quiet"]
    finally:
        query.stop()
