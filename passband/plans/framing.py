"""Framing: recordings to frames to packets, and what was lost on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.fixtures import views, wire
from passband.fixtures.views import oracle
from passband.functions.bits import to_octets
from passband.functions.checksum import crc16, crc32c
from passband.operators import channels, chunks, coding, csp, frames, markers, packets, pus, recovery, stream_split
from passband.operators.frames import FrameLayout
from passband.plans.decoding import MODE, RAW
from passband.plans.registry import plan
from passband.session import pin

LAYOUT = FrameLayout(has_fecf=True)
FRAME, UNIT = wire.FRAME, wire.UNIT
TEXT_MARKER = b"<p"

# The wire image as SQL: packets of a channel end to end, idle fill, frames of 50 octets.
WIRE_SQL = {
    "tlm_placed": """
        SELECT apid % 4 AS capture_id, epoch, CAST(apid // 4 % 8 AS INTEGER) AS vcid, pkt_no, apid, seq_count,
               (row_number() OVER (PARTITION BY apid % 4, epoch, apid // 4 % 8 ORDER BY pkt_no) - 1) * 11 AS place, 11 AS size
        FROM tlm_packet_lossy""",
    "tlm_channel": """
        SELECT capture_id, epoch, vcid, count(*) * 11 AS total,
               CASE WHEN 50 - count(*) * 11 % 50 < 7 THEN 100 - count(*) * 11 % 50 ELSE 50 - count(*) * 11 % 50 END AS pad
        FROM tlm_placed GROUP BY capture_id, epoch, vcid""",
    "tlm_unit": """
        SELECT capture_id, epoch, vcid, pkt_no, apid, seq_count, place, size, false AS idle FROM tlm_placed
        UNION ALL SELECT capture_id, epoch, vcid, NULL, 2047, 0, total, pad, true FROM tlm_channel""",
    "tlm_frames": """
        SELECT capture_id, epoch, vcid, k, k * 8 + vcid AS frame_no
        FROM (SELECT *, unnest(range((total + pad) // 50)) AS k FROM tlm_channel) c
        WHERE (k * 8 + vcid) % 23 <> 7""",
    "tlm_piece": """
        SELECT u.*, f.frame_no, f.frame_no IS NOT NULL AS kept, c.k AS cell,
               least((c.k + 1) * 50, u.place + u.size) - greatest(c.k * 50, u.place) AS octets
        FROM (SELECT *, unnest(range(place // 50, (place + size - 1) // 50 + 1)) AS k FROM tlm_unit) c
        JOIN tlm_unit u ON u.capture_id = c.capture_id AND u.epoch = c.epoch AND u.vcid = c.vcid AND u.place = c.place
        LEFT JOIN tlm_frames f ON f.capture_id = c.capture_id AND f.epoch = c.epoch AND f.vcid = c.vcid AND f.k = c.k""",
    "tlm_fate": """
        SELECT capture_id, epoch, vcid, pkt_no, apid, seq_count, idle, place, size, bool_and(kept) AS whole,
               bool_or(kept AND cell = place // 50) AS begun, max(frame_no) AS frame_no,
               sum(CASE WHEN kept THEN octets ELSE 0 END) AS held
        FROM tlm_piece GROUP BY ALL""",
}


def wire_oracle(sql: str, **extra: str) -> str:
    return oracle(sql, **WIRE_SQL, **extra)


@plan(
    "frame_headers",
    "F9",
    wire_oracle(
        """SELECT capture_id, frame_no, 0 AS version, 42 AS scid, vcid, CAST(frame_no % 256 AS INTEGER) AS mc_count,
                  CAST(k % 256 AS INTEGER) AS vc_count, 0 AS sync_flag, 3 AS segment_id, 50 AS data_bytes FROM tlm_frames"""
    ),
)
def frame_headers(spark: SparkSession, folder: str) -> DataFrame:
    projected = frames.project(wire.frames(spark, folder), LAYOUT)
    return projected.select(
        "capture_id", "frame_no", "version", "scid", "vcid", "mc_count", "vc_count", "sync_flag",
        "segment_id", F.length("data").alias("data_bytes"),
    )


def _damaged(frame: Column, number: Column) -> Column:
    """Frames damaged in known ways: version, cut short, secondary header, checksum."""
    first = F.substring(frame, 1, 1)
    return (
        F.when(number % 29 == 0, F.concat(F.unhex(F.lit("42")), F.expr("substring(frame, 2)")))
        .when(number % 31 == 0, F.substring(frame, 1, 5))
        .when(number % 37 == 0, F.concat(F.substring(frame, 1, 4), F.unhex(F.lit("9800")), F.unhex(F.lit("00")), F.expr("substring(frame, 8)")))
        .when(number % 41 == 0, F.concat(first, F.unhex(F.lit("FF")), F.expr("substring(frame, 3)")))
        .when(number % 43 == 0, F.substring(frame, 1, 7))
        .otherwise(frame)
    )


@plan(
    "frame_status",
    "F10 F11 A1",
    wire_oracle(
        """SELECT CASE WHEN frame_no % 29 = 0 THEN 'bad_version' WHEN frame_no % 31 = 0 THEN 'too_short'
                       WHEN frame_no % 37 = 0 THEN 'bad_secondary_header' WHEN frame_no % 41 = 0 THEN 'bad_checksum'
                       WHEN frame_no % 43 = 0 THEN 'too_short' ELSE 'ok' END AS status, count(*) AS frames
           FROM tlm_frames GROUP BY 1"""
    ),
)
def frame_status(spark: SparkSession, folder: str) -> DataFrame:
    recorded = wire.frames(spark, folder)
    damaged = recorded.withColumn("frame", _damaged(F.col("frame"), F.col("frame_no")))
    parsed = frames.parse(damaged, LAYOUT)
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("frames"))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    parsed = frames.parse(wire.frames(spark, folder), LAYOUT).filter(F.col("status") == "ok")
    return packets.segments(parsed)


@plan(
    "reassembled",
    "F14 F17 F21",
    wire_oracle(
        "SELECT capture_id, vcid, apid, seq_count AS sequence, size AS octets, frame_no FROM tlm_fate WHERE whole AND apid <> 2047"
    ),
)
def reassembled(spark: SparkSession, folder: str) -> DataFrame:
    whole = packets.header(packets.segment_packets(_read(spark, folder)))
    return whole.filter(~packets.is_idle(F.col("apid"))).select(
        F.col("capture_id").cast("int").alias("capture_id"), "vcid", "apid", "sequence", F.length("bytes").alias("octets"), "frame_no"
    )


@plan(
    "frame_losses",
    "F16 F24 F12",
    wire_oracle(
        """SELECT capture_id, vcid, CAST(sum(CASE WHEN begun AND NOT whole THEN 1 ELSE 0 END) AS BIGINT) AS lost,
                  CAST(sum(CASE WHEN NOT whole THEN held ELSE 0 END) AS BIGINT) AS discarded
           FROM tlm_fate GROUP BY 1, 2 HAVING sum(CASE WHEN NOT whole THEN held ELSE 0 END) > 0"""
    ),
)
def frame_losses(spark: SparkSession, folder: str) -> DataFrame:
    losses = packets.segment_losses(_read(spark, folder))
    return losses.groupBy(F.col("capture_id").cast("int").alias("capture_id"), "vcid").agg(
        F.sum(F.col("lost").cast("bigint")).alias("lost"), F.sum("discarded").alias("discarded")
    )


#: What of broken packets came through, put down to the packet start before it, and jumps of counts.
LOSS_SQL = {
    "opened": "SELECT DISTINCT capture_id, epoch, vcid, cell FROM tlm_piece WHERE kept AND cell = place // 50",
    "broken": """SELECT p.capture_id, p.epoch, p.vcid, p.cell, p.octets, p.cell = p.place // 50 AS begins
                 FROM tlm_piece p JOIN tlm_fate f ON f.capture_id = p.capture_id AND f.epoch = p.epoch AND f.vcid = p.vcid AND f.place = p.place
                 WHERE p.kept AND NOT f.whole""",
    "charged": """SELECT b.*, CASE WHEN begins THEN b.cell ELSE (SELECT max(o.cell) FROM opened o WHERE o.capture_id = b.capture_id
                      AND o.epoch = b.epoch AND o.vcid = b.vcid AND o.cell < b.cell) END AS home FROM broken b""",
    "lastly": """SELECT f.capture_id, f.epoch, f.vcid, o.cell AS home, max(f.k) - o.cell = count(*) AND count(*) = count(CASE WHEN f.k > o.cell THEN 1 END) AS unbroken
                 FROM (SELECT capture_id, epoch, vcid, max(cell) AS cell FROM opened GROUP BY 1, 2, 3) o
                 JOIN tlm_frames f ON f.capture_id = o.capture_id AND f.epoch = o.epoch AND f.vcid = o.vcid AND f.k > o.cell GROUP BY 1, 2, 3, o.cell""",
    "ended": """SELECT o.capture_id, o.epoch, o.vcid, o.cell AS home FROM (SELECT capture_id, epoch, vcid, max(cell) AS cell FROM opened GROUP BY 1, 2, 3) o
                LEFT JOIN lastly l ON l.capture_id = o.capture_id AND l.epoch = o.epoch AND l.vcid = o.vcid WHERE coalesce(l.unbroken, true)""",
    "told": """SELECT c.capture_id, c.epoch, c.vcid, c.home, count(CASE WHEN begins THEN 1 END) AS lost, sum(octets) AS discarded
               FROM charged c GROUP BY 1, 2, 3, 4""",
    "jumped": """SELECT capture_id, epoch, vcid, frame_no, (k - lag(k) OVER (PARTITION BY capture_id, epoch, vcid ORDER BY k) - 1) % 256 AS missing FROM tlm_frames""",
}


@plan(
    "loss_events",
    "F24 F12 F14",
    wire_oracle(
        """SELECT CAST(t.capture_id AS INTEGER) AS capture_id, t.vcid, t.home * 8 + t.vcid AS frame_no,
                  CASE WHEN t.home IS NULL THEN 'leading_fragment' WHEN t.lost = 0 THEN 'no_packet_in_front'
                       WHEN e.home IS NOT NULL THEN 'cut_off' ELSE 'abandoned' END AS kind,
                  CAST(t.lost AS INTEGER) AS lost, CAST(t.discarded AS BIGINT) AS discarded, 0 AS missing
           FROM told t LEFT JOIN ended e ON e.capture_id = t.capture_id AND e.epoch = t.epoch AND e.vcid = t.vcid AND e.home = t.home
           UNION ALL SELECT CAST(capture_id AS INTEGER), vcid, frame_no, 'frames_missing', 0, 0, CAST(missing AS INTEGER) FROM jumped WHERE missing > 0""",
        **LOSS_SQL,
    ),
)
def loss_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every jump, abandoned packet and fragment of the frames that came through."""
    parsed = pin(frames.parse(wire.frames(spark, folder), LAYOUT).filter(F.col("status") == "ok"))
    stepped = channels.with_continuity(parsed, keys=(*wire.CAPTURE_KEYS, "vcid"))
    events = packets.loss_events(stepped, packets.segments(parsed))
    return events.select(F.col("capture_id").cast("int").alias("capture_id"), "vcid", "frame_no", "kind", "lost", "discarded", "missing")


# --------------------------------------------------------------------------------- byte streams


def sliced_frames(recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    totals = recorded.groupBy(*wire.CAPTURE_KEYS).agg(
        F.max(F.col("offset") + F.length("bytes")).alias("total")
    )
    starts = markers.frame_starts(markers.scan(recorded), totals, FRAME)
    cells = recorded.select(
        *wire.CAPTURE_KEYS, F.col("chunk_no").alias("cell"), F.col("offset").alias("start"), F.col("bytes").alias("octets")
    )
    return starts, markers.cut_frames(cells, starts, FRAME, 256)


STREAM_SQL = {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY capture_id, epoch ORDER BY frame_no) - 1 AS r FROM tlm_frames",
    # Noise before rank 39 of forty throws the next four places off; the fifth is searched for.
    "locked": f"""SELECT *, r * {UNIT} + (r // 40) * 17 + CASE WHEN r % 40 = 39 THEN 17 ELSE 0 END + 4 AS start
                  FROM ranked WHERE NOT (r % 40 = 39 OR (r >= 40 AND r % 40 <= 2))""",
}


def _octet(digits: str, i: str) -> str:
    each = [f"(instr('0123456789ABCDEF', substr({digits}, CAST(2 * ({i}) + {k} AS BIGINT), 1)) - 1)" for k in (1, 2)]
    return f"({each[0]} * 16 + {each[1]})"


def _crc_sql(digits: str, octets: int) -> str:
    """The frame checksum of hex digits, octet by octet."""
    y = "xor(c >> 8, b)"
    x = f"xor({y}, ({y}) >> 4)"
    step = f"xor(xor(xor(c << 8, {x} << 12), {x} << 5), {x}) & 65535"
    return f"list_reduce(list_prepend(CAST(65535 AS BIGINT), list_transform(range({octets}), lambda i: CAST({_octet(digits, 'i')} AS BIGINT))), lambda c, b: {step})"


_FHP = f"(({_octet('w', '4')} & 7) * 256 + {_octet('w', '5')})"
_SECOND = f"CASE WHEN {_octet('w', '4')} >= 128 THEN ({_octet('w', '6')} & 63) + 1 ELSE 0 END"
#: Frames taken 17 octets too early, behind the noise, that pass every check by chance: one in 65,536 or
#: less.  The first place of each loss begins with noise, which is no version of a frame.
CHANCE_SQL = {
    "around": "SELECT capture_id, epoch, vcid, k, frame_no, r FROM ranked WHERE r >= 39 AND (r % 40 = 39 OR r % 40 <= 2)",
    "around_data": f"""
        SELECT n.capture_id, n.epoch, n.vcid, n.k, n.frame_no, n.r, min(CASE WHEN p.cell = p.place // 50 THEN p.place % 50 END) AS pointer,
               string_agg(substr(CASE WHEN p.idle THEN concat('0FFFC000', format('{{:04X}}', p.size - 7), repeat('00', p.size - 6))
                                      ELSE format('{{:04X}}{{:04X}}0004{{:02X}}{{:08X}}', p.apid + 2048, p.seq_count + 49152, {MODE}, {RAW}) END,
                                 CAST(2 * (greatest(p.cell * 50, p.place) - p.place) + 1 AS BIGINT), CAST(2 * p.octets AS BIGINT)), '' ORDER BY p.place) AS data
        FROM around n JOIN tlm_piece p ON p.capture_id = n.capture_id AND p.epoch = n.epoch AND p.vcid = n.vcid AND p.cell = n.k
        LEFT JOIN tlm_packet_lossy t ON t.pkt_no = p.pkt_no GROUP BY 1, 2, 3, 4, 5, 6""",
    "around_body": """
        SELECT *, concat(format('{:04X}{:02X}{:02X}{:04X}', 672 + vcid * 2, frame_no % 256, k % 256, coalesce(pointer, 2047) + 6144), data) AS body
        FROM around_data""",
    "around_frame": f"SELECT capture_id, epoch, r, concat(body, format('{{:04X}}', {_crc_sql('body', 56)})) AS f FROM around_body",
    "early": f"""
        SELECT a.capture_id, a.r * {UNIT} + a.r // 40 * 17 + 4 - 17 AS start, concat(substr(b.f, 91, 26), '{wire.MARKER}', substr(a.f, 1, 82)) AS w
        FROM around_frame a JOIN around_frame b ON b.capture_id = a.capture_id AND b.epoch = a.epoch AND b.r = a.r - 1 WHERE a.r % 40 <= 2""",
    "chance": f"""
        SELECT capture_id, start FROM early
        WHERE {_octet('w', '0')} < 64 AND ({_octet('w', '4')} < 128 OR {_SECOND} BETWEEN 2 AND 50)
          AND ({_octet('w', '4')} & 64 > 0 OR {_FHP} IN (2046, 2047) OR {_FHP} < 50 - {_SECOND})
          AND {_crc_sql('w', 56)} = {_octet('w', '56')} * 256 + {_octet('w', '57')}""",
}
CUT_SQL = """SELECT CAST(capture_id AS BIGINT) AS capture_id, CAST(start AS BIGINT) AS start, r % 40 NOT IN (10, 25) AS found FROM locked
           UNION ALL SELECT CAST(capture_id AS BIGINT), CAST(start AS BIGINT), false FROM chance"""


@plan(
    "frame_cut",
    "F1 F4 S1",
    wire_oracle(CUT_SQL, **STREAM_SQL, **CHANCE_SQL),
)
def frame_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Frames cut by lock and flywheel, those whose checksum holds."""
    _, cut = sliced_frames(wire.recording(spark, folder))
    good = frames.parse(cut, LAYOUT).filter(F.col("status") == "ok")
    return good.select(F.col("capture_id").cast("bigint").alias("capture_id"), F.col("frame_no").alias("start"), "found")


@plan(
    "frames_to_packets",
    "F23 F7 F4 F10 F14 A1",
    wire_oracle(
        """SELECT CAST(capture_id AS BIGINT) AS capture_id, count(*) AS frames_ok FROM locked GROUP BY 1""",
        **STREAM_SQL,
    ),
)
def frames_to_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Sync, derandomise, check: frames that come through per capture of a randomised stream."""
    _, cut = sliced_frames(wire.recording(spark, folder, randomised=True))
    clear = cut.withColumn("frame", coding.derandomise("frame"))
    parsed = frames.parse(clear, LAYOUT)
    return parsed.filter(F.col("status") == "ok").groupBy(F.col("capture_id").cast("bigint").alias("capture_id")).agg(
        F.count(F.lit(1)).alias("frames_ok")
    )


#: The coded recording: what frames come through sync, and of these the undamaged ones.
CODED_SQL = {
    **WIRE_SQL,
    **STREAM_SQL,
    "tlm_sent": WIRE_SQL["tlm_frames"],
    "ranked": STREAM_SQL["ranked"].replace("tlm_frames", "tlm_sent"),
    "tlm_frames": "SELECT * FROM locked WHERE r % 29 <> 5",
}


def coded_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames out of a randomised, coded recording."""
    layer = recovery.CodingLayer(True, wire.PARITY)
    return recovery.recovered_frames(
        wire.recording(spark, folder, randomised=True, coded=True), FRAME, LAYOUT, layer, chunk_octets=256
    )


@plan(
    "recovered_packets",
    "F23 F7 F8",
    oracle(
        """SELECT CAST(capture_id AS BIGINT) AS capture_id, apid, count(*) AS packets, CAST(sum(size) AS BIGINT) AS octets
           FROM tlm_fate WHERE whole AND apid <> 2047 GROUP BY 1, 2""",
        **CODED_SQL,
    ),
)
def recovered_packets(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain, down to packets per APID: frames of damaged blocks break the packets in them."""
    frames_ = coded_frames(spark, folder).withColumn("received", F.timestamp_seconds(F.col("frame_no")))
    whole = recovery.recovered_packets(frames_)
    return whole.groupBy(F.col("capture_id").cast("bigint").alias("capture_id"), "apid").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.length("bytes").cast("bigint")).alias("octets")
    )


@plan(
    "coding_order",
    "F23 F7 F8 F10",
    oracle(
        """SELECT CAST(capture_id AS BIGINT) AS capture_id, derandomised, count(*) AS clean, CASE WHEN derandomised THEN count(*) ELSE 0 END AS ok
           FROM tlm_frames CROSS JOIN (VALUES (true), (false)) o(derandomised) GROUP BY 1, 2""",
        **CODED_SQL,
    ),
)
def coding_order(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that screen clean, and good frames in them, with the derandomiser and without it.

    Left out, it shows in no block, for its sequence is a code word; but no frame makes sense.
    """
    recorded = wire.recording(spark, folder, randomised=True, coded=True)
    # Where a block lies does not depend on what is done to it: both orders read the same blocks.
    blocks = pin(recovery.cut_blocks(recorded, wire.BLOCK, chunk_octets=256))
    each = [
        recovery.block_frames(blocks, FRAME, LAYOUT, recovery.CodingLayer(randomised, wire.PARITY)).withColumn("derandomised", F.lit(randomised))
        for randomised in (True, False)
    ]
    both = each[0].unionByName(each[1])
    return both.groupBy(F.col("capture_id").cast("bigint").alias("capture_id"), "derandomised").agg(
        F.count(F.when(~F.col("dirty"), 1)).alias("clean"), F.count(F.when(F.col("status") == "ok", 1)).alias("ok")
    )


def _marker_sql(marker: bytes) -> str:
    cut = f"string_split(html, '{marker.decode()}')"
    return f"""
    SELECT capture_id, CAST(list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + {len(marker)} * (i - 1) AS BIGINT) AS pos
    FROM (SELECT page_id AS capture_id, {cut} AS parts, unnest(range(1, len({cut}))) AS i FROM pages) s"""


MARKER_SQL = _marker_sql(TEXT_MARKER)
#: Four octets, as long as the marker of recordings: no other place of a capture holds them by chance.
LONG_MARKER = b"</p>"
STRIDE_SQL = """
    SELECT capture_id, stride, count(*) AS intervals FROM (
        SELECT capture_id, pos - lag(pos) OVER (PARTITION BY capture_id ORDER BY pos) AS stride FROM found) d
    WHERE stride IS NOT NULL GROUP BY 1, 2"""


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return markers.scan(views.captures(spark, folder), TEXT_MARKER)


@plan("marker_scan", "F1", oracle("SELECT capture_id, pos FROM found", found=MARKER_SQL))
def marker_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("capture_id", "pos")


@plan(
    "bit_slip_scan",
    "F5 F1",
    oracle("SELECT capture_id, pos, CAST(capture_id % 8 AS INTEGER) AS bit FROM found", found=_marker_sql(LONG_MARKER)),
)
def bit_slip_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Captures slipped by none to seven bits: all places where their markers are found, at any offset."""
    found = markers.scan(views.slipped_captures(spark, folder), LONG_MARKER, bit_slip=True)
    return found.select("capture_id", "pos", "bit")


@plan(
    "stride_mode",
    "F2",
    oracle(
        """SELECT capture_id, arg_max(stride, intervals * 1000000 - stride) AS stride, max(intervals) AS intervals,
                  CAST(sum(intervals) AS BIGINT) AS total FROM strides GROUP BY 1""",
        found=MARKER_SQL,
        strides=STRIDE_SQL,
    ),
)
def stride_mode(spark: SparkSession, folder: str) -> DataFrame:
    histogram = markers.strides(_found(spark, folder))
    return markers.modal_stride(histogram).drop("epoch")


@plan(
    "frame_advice",
    "F3",
    oracle(
        """SELECT capture_id, stride, CASE WHEN stride <= 2 THEN 'not_frames' WHEN (stride - 2) % 255 = 0 AND (stride - 2) // 255 IN (1, 2, 3, 4, 5, 8) THEN 'coded' ELSE 'uncoded' END AS kind,
                  CASE WHEN stride <= 2 THEN NULL WHEN (stride - 2) % 255 = 0 AND (stride - 2) // 255 IN (1, 2, 3, 4, 5, 8) THEN (stride - 2) // 255 * 223 ELSE stride - 2 END AS frame_length,
                  intervals * 2 >= total AS consistent
           FROM (SELECT capture_id, arg_max(stride, intervals * 1000000 - stride) AS stride, max(intervals) AS intervals,
                        CAST(sum(intervals) AS BIGINT) AS total FROM strides GROUP BY 1) m""",
        found=MARKER_SQL,
        strides=STRIDE_SQL,
    ),
)
def frame_advice(spark: SparkSession, folder: str) -> DataFrame:
    modal = markers.modal_stride(markers.strides(_found(spark, folder)))
    told = markers.advice(modal, len(TEXT_MARKER))
    return told.select("capture_id", "stride", "kind", "frame_length", "consistent")


@plan(
    "candidate_hits",
    "F3",
    oracle(
        """SELECT c.candidate, CAST(coalesce(sum(CASE WHEN stride = candidate THEN intervals END), 0) AS BIGINT) AS bare,
                  CAST(coalesce(sum(CASE WHEN stride = candidate + 2 THEN intervals END), 0) AS BIGINT) AS with_marker
           FROM strides CROSS JOIN (VALUES (21), (48), (75), (150)) c(candidate) GROUP BY 1""",
        found=MARKER_SQL,
        strides=STRIDE_SQL,
    ),
)
def candidate_hits(spark: SparkSession, folder: str) -> DataFrame:
    histogram = markers.strides(_found(spark, folder)).withColumn("all", F.lit(0))
    return markers.candidate_hits(histogram, ["all"], (21, 48, 75, 150), 2).drop("all")


@plan(
    "fixed_length_cut",
    "F6",
    oracle(
        """SELECT page_id AS capture_id, cell, CAST(least(100, strlen(html) - cell * 100) AS INTEGER) AS octets
           FROM (SELECT *, unnest(range(CAST(ceil(strlen(html) / 100) AS BIGINT))) AS cell FROM pages) p"""
    ),
)
def fixed_length_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Every 100 octets is a frame; the last one of a recording may be short."""
    pieces = views.captures(spark, folder).withColumnRenamed("bytes", "octets")
    cut = chunks.recut(pieces, ["capture_id"], 100)
    return cut.select("capture_id", "cell", F.length("octets").alias("octets"))


@plan(
    "byte_prefix",
    "P9",
    oracle("SELECT page_id AS capture_id, CAST(least(strlen(html), 500) AS INTEGER) AS octets FROM pages"),
)
def byte_prefix(spark: SparkSession, folder: str) -> DataFrame:
    kept = chunks.prefix(views.captures(spark, folder), 500)
    return kept.select("capture_id", F.length("bytes").alias("octets"))


@plan(
    "derandomised",
    "F7",
    oracle("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS octets, md5(text) AS digest FROM documents"),
)
def derandomised(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts randomised and derandomised again."""
    octets = F.encode("text", "UTF-8")
    noisy = views.table(spark, folder, "documents").select("doc_id", coding.derandomise(octets).alias("noise"))
    clear = noisy.select("doc_id", coding.derandomise("noise").alias("b"))
    return clear.select("doc_id", F.length("b").alias("octets"), F.md5("b").alias("digest"))


@plan(
    "codeblock_screen",
    "F8",
    oracle(
        """SELECT event_type, user_id % 4 AS wrong, user_id % 4 > 0 AS dirty, count(*) AS blocks FROM events GROUP BY 1, 2, 3"""
    ),
)
def codeblock_screen(spark: SparkSession, folder: str) -> DataFrame:
    """One code block per event: a rotated code word, with as many wrong symbols as the user says.

    The code is cyclic, so every rotation of a code word is one; one to sixteen wrong symbols
    never make another.
    """
    doubled = F.unhex(F.lit((coding.randomiser().tobytes() * 2).hex()))
    turn = (F.col("event_id") % 255).cast("int")
    wrong = (F.col("user_id") % 4).cast("int")
    word = F.substring(doubled, turn + 1, F.lit(255))
    flipped = F.concat(
        F.unhex(F.repeat(F.lit("5A"), wrong)), F.unhex(F.repeat(F.lit("00"), F.lit(255) - wrong))
    )
    blocks = views.table(spark, folder, "events").select(
        "event_type", wrong.cast("bigint").alias("wrong"), word.alias("word"), flipped.alias("mask")
    )
    mixed = blocks.withColumn("block", coding.combine("word", "mask"))
    return coding.screened(mixed).groupBy("event_type", "wrong", "dirty").agg(F.count(F.lit(1)).alias("blocks"))


# ------------------------------------------------------------------------------------- messages


def messages_of(spark: SparkSession, folder: str) -> DataFrame:
    """Four packets per message by number; some messages are cut, some have a bad length."""
    packed = views.packet_bytes(spark, folder).select(
        F.call_function("div", F.col("pkt_no"), F.lit(4)).alias("msg_id"), "pkt_no", F.col("bytes").alias("octets")
    )
    whole = packed.groupBy("msg_id").agg(
        F.sort_array(F.collect_list(F.struct("pkt_no", "octets"))).alias("_p")
    )
    octets = chunks.joined_octets(F.col("_p"))
    spoiled = F.concat(octets, F.unhex(F.lit("08000000FFFF00")))
    cut = F.substring(octets, F.lit(1), F.length(octets) - 4)
    body = F.when(F.col("msg_id") % 10 == 3, cut).when(F.col("msg_id") % 10 == 7, spoiled).otherwise(octets)
    return whole.select("msg_id", body.alias("bytes"))


@plan(
    "message_packets",
    "F15 S3",
    oracle(
        """SELECT pkt_no // 4 AS msg_id, CAST(count(*) - CASE WHEN pkt_no // 4 % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS packets
           FROM tlm_packet_lossy GROUP BY pkt_no // 4
           HAVING count(*) - CASE WHEN pkt_no // 4 % 10 = 3 THEN 1 ELSE 0 END > 0"""
    ),
)
def message_packets(spark: SparkSession, folder: str) -> DataFrame:
    split = packets.walked(messages_of(spark, folder), max_length=4096)
    whole = packets.message_packets(split, ["msg_id"])
    return whole.groupBy("msg_id").agg(F.count(F.lit(1)).alias("packets"))


@plan(
    "message_residuals",
    "F16 F18",
    oracle(
        """SELECT msg_id, CASE WHEN msg_id % 10 = 3 THEN 1 ELSE 0 END AS lost, 7 AS discarded,
                  CASE WHEN msg_id % 10 = 3 THEN 'cut_off' ELSE 'desync' END AS reason
           FROM (SELECT DISTINCT pkt_no // 4 AS msg_id FROM tlm_packet_lossy) m WHERE msg_id % 10 IN (3, 7)"""
    ),
)
def message_residuals(spark: SparkSession, folder: str) -> DataFrame:
    split = packets.walked(messages_of(spark, folder), max_length=4096)
    return packets.message_residuals(split, ["msg_id"])


@plan(
    "stream_packets",
    "F15 F17",
    wire_oracle("SELECT capture_id * 8 + vcid AS stream, CAST(place AS BIGINT) AS place, size AS octets FROM tlm_unit WHERE apid <> 2047"),
)
def stream_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Back-to-back packets of every channel's recording, in chunks of 64 octets."""
    units = wire.packet_streams(spark, folder).withColumn("stream", F.col("capture_id") * 8 + F.col("vcid"))
    cut = chunks.recut(units, ["stream", "epoch"], 64).select(
        "stream", "epoch", F.col("cell").alias("chunk_no"), F.col("start").alias("offset"),
        F.timestamp_seconds(F.col("cell")).alias("received"), F.col("octets").alias("bytes"),
    )
    whole, _ = stream_split.split(cut, keys=("stream", "epoch"))
    named = packets.header(whole)
    return named.filter(~packets.is_idle(F.col("apid"))).select(
        F.col("stream").cast("int").alias("stream"), F.col("offset").alias("place"), F.length("bytes").alias("octets")
    )


@plan(
    "csp_messages",
    "F19 F20",
    oracle(
        """SELECT status, count(*) AS messages, CAST(coalesce(sum(payload), 0) AS BIGINT) AS payload, max(source) AS source FROM (
               SELECT CASE WHEN event_id % 13 = 0 THEN 'too_short' WHEN event_id % 11 = 0 THEN 'hmac' WHEN event_id % 7 = 0 THEN 'rdp'
                           WHEN event_id % 5 = 0 THEN 'bad_checksum' ELSE 'ok' END AS status,
                      CASE WHEN NOT (event_id % 13 = 0 OR event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0) THEN strlen(props) END AS payload,
                      CASE WHEN event_id % 13 <> 0 THEN CAST(user_id % 32 AS INTEGER) END AS source
               FROM events) e GROUP BY status"""
    ),
)
def cspmessages_of(spark: SparkSession, folder: str) -> DataFrame:
    """Messages around the event properties: checksums over both ranges, damage and refusals."""
    n = F.col("event_id")
    flags = F.when(n % 11 == 0, csp.HMAC).when(n % 7 == 0, csp.RDP | csp.CRC32).otherwise(csp.CRC32)
    word = (F.col("user_id") % 32) * (1 << 25) + flags
    head, body = to_octets(word, 4), F.encode("props", "UTF-8")
    covered = F.when(n % 2 == 0, F.col("body")).otherwise(F.concat("head", "body"))
    events = views.table(spark, folder, "events").select("event_id", head.alias("head"), body.alias("body"))
    summed = events.withColumn("crc", crc32c(covered))
    wrong = F.when(n % 5 == 0, F.pmod(F.col("crc") + 1, F.lit(1 << 32))).otherwise(F.col("crc"))
    sent = F.when(n % 13 == 0, F.substring("head", 1, 3)).otherwise(F.concat("head", "body", to_octets(wrong, 4)))
    parsed = csp.parse(summed.select(sent.alias("bytes")), 1)
    return parsed.groupBy("status").agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("payload"),
        F.max("source").alias("source"),
    )


@plan(
    "service_rollup",
    "F22 F11",
    oracle(
        """SELECT CAST(user_id % 64 AS INTEGER) AS apid, CAST(event_id % 3 + 1 AS BIGINT) AS service, CAST(25 AS BIGINT) AS subtype, count(*) AS packets,
                  count(CASE WHEN event_id % 17 = 4 THEN 1 END) AS bad_crc,
                  CAST(count(CASE WHEN event_id % 17 = 4 THEN 1 END) AS DOUBLE) / count(*) AS bad_crc_rate
           FROM events GROUP BY 1, 2"""
    ),
)
def service_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Service packets around the event properties; one checksum in seventeen is wrong."""
    n = F.col("event_id")
    body = F.encode("props", "UTF-8")
    front = F.concat(
        to_octets(F.lit(2048) + F.col("user_id") % 64, 2),
        to_octets(F.lit(49152) + n % 16384, 2),
        to_octets(F.length(body) + 14, 2),
        F.unhex(F.lit("20")),
        to_octets(n % 3 + 1, 1),
        F.unhex(F.lit("19")),
        to_octets(n % 65536, 2),
        F.unhex(F.lit("0001")),
        to_octets(n, 4),
        F.unhex(F.lit("8000")),
        body,
    )
    built = views.table(spark, folder, "events").select("event_id", front.alias("front"))
    summed = built.withColumn("crc", crc16("front"))
    wrong = F.when(n % 17 == 4, F.pmod(F.col("crc") + 1, F.lit(65536))).otherwise(F.col("crc"))
    sent = summed.select(F.concat("front", to_octets(wrong, 2)).alias("bytes"))
    return pus.service_rollup(pus.audit(sent))
