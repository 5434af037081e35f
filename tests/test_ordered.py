"""Sliced scans must give the unsliced answer for any slice width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passband.operators import events as log
from passband.operators import gaps, link
from passband.operators.ordered import carry, newest


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(i * rng.randint(1, 1) + (i // 7) * 3, rng.choice("aaab"), rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 16, 1000])
def test_carry_equals_window(spark, width):
    df = spark.createDataFrame(rows_of(1), "n bigint, k string, v int")
    w = Window.partitionBy("k").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "n", "k", F.lag("v").over(w), F.coalesce(F.sum("v").over(upto), F.lit(0)), F.max("v").over(upto),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    got = carry(
        df, ["k"], "n", previous={"p": "v"}, sums={"s": F.col("v")}, highs={"h": F.col("v")},
        highs_before={"b": F.col("v")}, width=width,
    ).select("n", "k", "p", "s", "h", "b")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("width", [2, 50])
def test_newest(spark, width):
    df = spark.createDataFrame(rows_of(2), "n bigint, k string, v int")
    got = {}
    for r in newest(df, ["k"], "n", 5, width=width).collect():
        got.setdefault(r.k, []).append(r.n)
    for k in ("a", "b"):
        assert sorted(got[k]) == sorted(n for n, key, _ in rows_of(2) if key == k)[-5:]


def tracker(counts, healthy, every):
    """The sequential rule, one packet at a time."""
    lines, last, g, m, ok = [], None, 0, 0, 0
    for rn, c in enumerate(counts, 1):
        c %= 16384
        missed = 0 if last is None or c == last else (c + 16384 - last - 1) % 16384
        last = c
        if missed == 0:
            ok += 1
            if ok >= healthy and g:
                lines.append((rn, "recovered", g, m))
                g = m = ok = 0
            continue
        ok, m, g = 0, m + missed, g + 1
        if g == 1:
            lines.append((rn, "first", g, m))
        elif g % every == 0:
            lines.append((rn, "running", g, m))
    return lines


@pytest.mark.parametrize("width", [4, 64, 10_000])
def test_dropouts_follow_the_sequential_rule(spark, width):
    rng = random.Random(11)
    rows, want, n = [], {}, 0
    for apid in range(4):
        c, counts = rng.randint(0, 16383), []
        for _ in range(160):
            c += rng.choice([1] * 12 + [2, 5, 0]) if apid else rng.choice([1, 3])
            counts.append(c % 16384)
        want[apid] = tracker(counts, 6, 3)
        for count in counts:
            rows.append((n, 0, apid, count))
            n += 1
    df = spark.createDataFrame(rows, "pkt_no bigint, epoch int, apid int, seq_count int")
    got = {}
    for r in gaps.dropout_sessions(df, width=width, healthy_run=6, summary_interval=3).collect():
        got.setdefault(r.apid, []).append((r.rn, r.kind, r.gaps, r.missing))
    assert {a: sorted(v) for a, v in got.items()} == {a: sorted(v) for a, v in want.items() if v}


def test_two_gap_semantics_and_wrap(spark):
    rows = [(0, 0, 5, 16382), (1, 0, 5, 16383), (2, 0, 5, 0), (3, 0, 5, 0), (4, 0, 5, 3), (5, 0, 3000, 9), (6, 0, None, 1)]
    df = spark.createDataFrame(rows, "pkt_no bigint, epoch int, apid int, seq_count int").withColumn("pkt_len", F.lit(9))
    missed = {r.pkt_no: r.missed for r in gaps.with_missed(df).collect()}
    assert missed == {0: 0, 1: 0, 2: 0, 3: 0, 4: 2}
    tally = gaps.apid_tally(df).first()
    assert (tally.packets, tally.gaps, tally.missing) == (5, 2, 16383 + 2)


def test_removed_packets_of_a_pass(spark):
    """A 7 200-packet pass without four of them has two gaps and four missing."""
    gone = {1000, 1001, 1002, 4000}
    df = spark.range(7200).filter(~F.col("id").isin(*gone)).select(
        F.col("id").alias("pkt_no"), F.lit(0).alias("epoch"), F.lit(11).alias("apid"), (F.col("id") + 2606).cast("int").alias("seq_count")
    )
    totals = gaps.gap_totals(gaps.with_missed(df, width=512)).first()
    assert tuple(totals) == (2, 4)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_event_collapse(spark, width):
    rng = random.Random(3)
    rows = [(i, i * 10, 0, "link", rng.choice("xxy")) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_no bigint, event_time bigint, severity int, source string, message string")
    want, runs = [], []
    for r in rows:
        if runs and runs[-1][2] == r[4]:
            runs[-1][1], runs[-1][3] = r[1], runs[-1][3] + 1
        else:
            runs.append([r[0], r[1], r[4], 1])
    got = sorted((r.run, r.event_time, r.message, r.repeats) for r in log.collapse(df, width=width).collect())
    assert got == [tuple(r) for r in runs]


@pytest.mark.parametrize("width", [11, 40, 10_000])
def test_rates_do_not_depend_on_slices(spark, width):
    rng = random.Random(9)
    ticks, t, b, p = [], 0, 0, 0
    for _ in range(120):
        t += rng.choice([1, 1, 2, 13])
        b += rng.randint(0, 500)
        p += rng.randint(0, 3)
        ticks.append((t, b, p))
    df = spark.createDataFrame(ticks, "tick bigint, bytes bigint, packets bigint")
    got = {r.tick: r.bytes_per_second for r in link.rates(df, width=width).collect()}
    for t, b, p in ticks:
        first = next(x for x in ticks if x[0] >= t - 10)
        want = (b - first[1]) / ((t - first[0]) * 0.5) if first[0] < t else 0.0
        assert got[t] == pytest.approx(want)
