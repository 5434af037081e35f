"""Export lines of packets decoded for them, against those of decoded samples."""

from passband.fixtures import views
from passband.functions import text
from passband.operators import decommutate
from passband.plans.decoding import tables
from passband.sources import definition, exports

FOLDER = "/root/testdata/sf0.001"


def test_lines_are_those_of_samples(spark):
    wire = views.packet_bytes(spark, FOLDER).withColumn("received_ns", views.micros("received") * 1000).withColumnRenamed("seq_count", "sequence")
    decoder = decommutate.Decommutator(definition.compile_definition(tables(spark)))
    want = exports.sample_rows(decommutate.explode_samples(decoder.decode(wire), ["received_ns", "apid", "sequence"]))
    got = exports.packet_lines(decoder.decode(wire, form=text.value_parts).filter("reason IS NULL"))
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
