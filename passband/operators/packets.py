"""Space packets: header projection, splitting messages, reassembly across frames."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from passband.functions.bits import unsigned
from passband.operators.channels import FRAME_COUNT_MODULUS, route
from passband.operators.ordered import DEFAULT_WIDTH, SLICE, carry, slice_of
from passband.session import pin

HEADER_BYTES = 6
IDLE_APID = 0x7FF
#: What a 16-bit length field can declare at most; a smaller bound turns on the desync guard.
LONGEST_PACKET = 65_542


def check_max_length(max_length: int) -> int:
    if max_length < HEADER_BYTES + 1:
        raise ValueError(f"max_packet_length is {max_length}: the shortest packet has 7 octets")
    return max_length


def header(packets: DataFrame, *, octets: str = "bytes") -> DataFrame:
    """apid, sequence count and declared length; null below six octets."""
    b = F.col(octets)
    whole = F.length(b) >= HEADER_BYTES
    return packets.withColumns(
        {
            "apid": F.when(whole, unsigned(b, 5, 11)).cast("int"),
            "sequence": F.when(whole, unsigned(b, 18, 14)).cast("int"),
            "declared_length": F.when(whole, unsigned(b, 32, 16) + HEADER_BYTES + 1).cast("int"),
        }
    )


def is_idle(apid: Column) -> Column:
    return apid == IDLE_APID


# ----------------------------------------------------------------------- messages (datagrams)


def _declared(octets: bytes, at: int) -> int:
    return HEADER_BYTES + 1 + (octets[at + 4] << 8 | octets[at + 5])


def walk_message(octets: bytes, max_length: int) -> tuple[list[int], int, bool]:
    """Packet starts in one message, where reading stopped, and whether that was a desync."""
    starts, at, size = [], 0, len(octets)
    while at + HEADER_BYTES <= size:
        declared = _declared(octets, at)
        if declared > max_length:
            return starts, at, True
        if at + declared > size:
            break
        starts.append(at)
        at += declared
    return starts, at, False


def walked(
    messages: DataFrame, *, octets: str = "bytes", max_length: int = LONGEST_PACKET
) -> DataFrame:
    """Add ``starts``, ``consumed`` and ``desync`` to messages that hold whole packets.

    Each row stands alone: no state crosses a message boundary, so this needs no shuffle.
    """
    check_max_length(max_length)

    @pandas_udf("struct<starts:array<int>,consumed:int,desync:boolean>")
    def walk(rows: pd.Series) -> pd.DataFrame:
        each = [walk_message(bytes(b or b""), max_length) for b in rows]
        return pd.DataFrame(each, columns=["starts", "consumed", "desync"])

    return messages.withColumn("_walk", walk(F.col(octets))).select("*", "_walk.*").drop("_walk")


def message_packets(
    split: DataFrame, keys: Sequence[str], *, octets: str = "bytes"
) -> DataFrame:
    """One row per whole packet of a :func:`walked` message."""
    after = F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0)))
    ends = F.concat(after, F.array("consumed"))
    spans = F.zip_with(
        "starts", ends, lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    )
    return (
        split.filter(F.size("starts") > 0)
        .select(*keys, octets, F.posexplode(spans).alias("pkt_index", "_p"))
        .select(
            *keys,
            "pkt_index",
            F.col("_p.start").alias("offset"),
            F.substring(
                F.col(octets), F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start")
            ).alias("bytes"),
        )
    )


def message_residuals(
    split: DataFrame, keys: Sequence[str], *, octets: str = "bytes"
) -> DataFrame:
    """What a message held besides whole packets: a cut-off packet, or the rest after a desync."""
    left = F.length(octets) - F.col("consumed")
    return split.filter(left > 0).select(
        *keys,
        F.when(F.col("desync"), 0).otherwise(1).alias("lost"),
        left.alias("discarded"),
        F.when(F.col("desync"), "desync").otherwise("cut_off").alias("reason"),
    )


# ------------------------------------------------------------------- reassembly across frames


def assemble_segment(
    pieces: Sequence[bytes], closed: bool, max_length: int
) -> tuple[list[dict], int, int, int, int, bool]:
    """Packets of one segment: the rest of a frame behind its pointer, then what continues it.

    Returns packets (octets and the piece that completed them), lost packets, discarded octets,
    octets still pending, octets left over after a packet that ended early, and whether a
    declared length was out of bounds.
    """
    rest, at, lost, discarded, early, oversize = bytes(pieces[0]), 0, 0, 0, 0, False
    out: list[dict] = []
    partial = b""
    while at < len(rest):
        left = len(rest) - at
        declared = _declared(rest, at) if left >= HEADER_BYTES else None
        if declared is not None and declared > max_length:
            discarded, oversize, at = left, True, len(rest)
        elif declared is None or declared > left:
            partial, at = rest[at:], len(rest)
        else:
            out.append({"bytes": rest[at : at + declared], "piece": 0})
            at += declared
    used, pending = 1, 0
    if partial:
        held = bytearray(partial)
        while used < len(pieces):
            held += pieces[used]
            used += 1
            if len(held) < HEADER_BYTES:
                continue
            declared = _declared(held, 0)
            if declared > max_length:
                lost, discarded, oversize, held = 1, discarded + len(held), True, bytearray()
                break
            if len(held) >= declared:
                early = len(held) - declared
                out.append({"bytes": bytes(held[:declared]), "piece": used - 1})
                discarded, held = discarded + early, bytearray()
                break
        if held and closed:
            lost, discarded = 1, discarded + len(held)
        elif held:
            pending = len(held)
    discarded += sum(len(p) for p in pieces[used:])
    return out, lost, discarded, pending, early, oversize


def segments(
    frames: DataFrame,
    *,
    keys: Sequence[str] = ("capture_id", "epoch"),
    max_length: int = LONGEST_PACKET,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Frames of each virtual channel cut at every first-header pointer, and read into packets.

    A pointer is a fresh start: what lies behind it does not depend on anything before it, so a
    channel falls apart into segments that are read in parallel however hot the channel is.
    ``frames`` are those that parsed, with frame_no, vcid, vc_count, sync_flag, fhp, data and
    received.  A row without ``segment`` carries the octets nothing could use.
    """
    check_max_length(max_length)
    channel = [*keys, "vcid"]
    # Where a frame belongs follows from its header alone: the ordered passes run on a few
    # dozen octets per frame, written once, and the data fields are joined to the outcome.
    headers = pin(
        frames.select(
            *channel,
            "frame_no",
            "received",
            "vc_count",
            "fhp",
            route(F.col("sync_flag"), F.col("fhp")).alias("route"),
            F.length("data").cast("bigint").alias("_size"),
        )
    ).withColumn(SLICE, slice_of("frame_no", width))
    following = F.when(F.col("route") == "continuation", F.col("_size")).otherwise(0)
    counted = carry(
        headers, channel, "frame_no", previous={"_count": "vc_count"}, sums={"_cum": following}
    )
    jump = F.pmod(F.col("vc_count") - F.col("_count") - 1, F.lit(FRAME_COUNT_MODULUS)) != 0
    starts = F.col("route") == "start"
    marked = carry(
        counted.withColumn("_jump", F.coalesce(jump, F.lit(False))),
        channel,
        "frame_no",
        highs={"_gap": F.when(F.col("_jump"), F.col("frame_no"))},
        highs_before={
            "_open": F.when(starts, F.col("frame_no")),
            "_cum0": F.when(starts, F.col("_cum")),
        },
    )
    placed = marked.join(frames.select(*keys, "frame_no", "data"), [*keys, "frame_no"])
    broken = F.coalesce(F.col("_gap") > F.col("_open"), F.lit(False))
    # No packet reaches further than its longest length into the frames that continue it;
    # what lies beyond is discarded without being collected.
    reachable = F.col("_cum") - following - F.coalesce("_cum0", F.lit(0)) < max_length

    def piece(segment: Column, octets: Column, usable: Column, closes: Column) -> Column:
        return F.struct(
            segment.alias("segment"), octets.alias("octets"), usable.alias("usable"), closes.alias("closes")
        )

    pointer = F.least(F.col("fhp"), F.length("data"))
    own = piece(
        F.col("frame_no"),
        F.substring("data", pointer + 1, F.length("data")),
        F.lit(True),
        F.lit(False),
    )
    head = piece(F.col("_open"), F.substring(F.col("data"), F.lit(1), pointer), ~broken, F.lit(True))
    more = piece(F.col("_open"), F.col("data"), ~broken & reachable, broken)
    mark = piece(F.col("_open"), F.lit(None).cast("binary"), F.lit(False), broken)
    pieces = (
        F.when(starts, F.array(own, head))
        .when(F.col("route") == "continuation", F.array(more))
        .otherwise(F.array(mark))
    )
    rows = placed.select(*channel, "frame_no", "received", F.inline(pieces))
    usable = F.col("segment").isNotNull() & F.col("usable")
    grouped = rows.groupBy(*channel, "segment").agg(
        F.sort_array(
            F.collect_list(F.when(usable, F.struct("frame_no", "received", "octets")))
        ).alias("pieces"),
        F.max("closes").alias("closed"),
        F.coalesce(F.sum(F.when(~usable, F.length("octets").cast("bigint"))), F.lit(0)).alias("_unused"),
    )

    @pandas_udf(
        "struct<packets:array<struct<bytes:binary,piece:int>>,lost:int,discarded:bigint,"
        "pending:int,early:int,oversize:boolean>"
    )
    def read(octets: pd.Series, closed: pd.Series) -> pd.DataFrame:
        each = [
            assemble_segment(p, bool(c), max_length) if len(p) else ([], 0, 0, 0, 0, False)
            for p, c in zip(octets, closed)
        ]
        names = ["packets", "lost", "discarded", "pending", "early", "oversize"]
        return pd.DataFrame(each, columns=names)

    return (
        grouped.withColumn("_r", read(F.col("pieces.octets"), F.col("closed")))
        .select(*channel, "segment", "pieces", "closed", "_unused", "_r.*")
        .withColumn("discarded", F.col("discarded") + F.col("_unused"))
        .drop("_unused")
    )


def segment_packets(
    read: DataFrame, keys: Sequence[str] = ("capture_id", "epoch")
) -> DataFrame:
    """Packets with the frame that completed them and its receipt time; idle fill included."""
    each = read.select(*keys, "vcid", "pieces", F.posexplode("packets").alias("pkt_index", "_p"))
    done = F.get("pieces", F.col("_p.piece"))
    return each.select(
        *keys,
        "vcid",
        done["frame_no"].alias("frame_no"),
        "pkt_index",
        done["received"].alias("received"),
        F.col("_p.bytes").alias("bytes"),
    )


def segment_losses(
    read: DataFrame, keys: Sequence[str] = ("capture_id", "epoch"), *, end_of_stream: bool = True
) -> DataFrame:
    """Residual rows: abandoned and oversize packets, leading fragments, early packet ends.

    At the end of a stream a packet still pending is one lost packet and its octets.
    """
    pending = F.col("pending") if end_of_stream else F.lit(0)
    reason = (
        F.when(F.col("segment").isNull(), "leading_fragment")
        .when(F.col("oversize"), "desync")
        .when(F.col("lost") > 0, "abandoned")
        .when(pending > 0, "cut_off")
        .when(F.col("early") > 0, "early_end")
        .otherwise("no_packet_in_front")
    )
    lost = F.col("lost") + F.when(pending > 0, 1).otherwise(0)
    discarded = F.col("discarded") + pending
    return read.filter((lost > 0) | (discarded > 0)).select(
        *keys, "vcid", "segment", reason.alias("reason"), lost.alias("lost"), discarded.alias("discarded")
    )


def loss_events(
    continuity: DataFrame, read: DataFrame, keys: Sequence[str] = ("capture_id", "epoch"), *, end_of_stream: bool = True
) -> DataFrame:
    """The loss log of framing, one row per event: jumps of a channel's frame count, and the residual
    rows of its segments.

    ``continuity`` are frames with ``missing``, ``read`` the segments of the same frames.  An event
    stands at the frame it shows in, or at the one whose packet it cost; octets that came before any
    packet start stand at no frame.
    """
    jumps = continuity.filter(F.col("missing") > 0).select(
        *keys, "vcid", "frame_no", F.lit("frames_missing").alias("kind"),
        F.lit(0).alias("lost"), F.lit(0).cast("bigint").alias("discarded"), F.col("missing").cast("int").alias("missing"),
    )
    losses = segment_losses(read, keys, end_of_stream=end_of_stream).select(
        *keys, "vcid", F.col("segment").alias("frame_no"), F.col("reason").alias("kind"),
        F.col("lost").cast("int").alias("lost"), "discarded", F.lit(0).alias("missing"),
    )
    return jumps.unionByName(losses)


def loss_lines(events: DataFrame, received: str | None = None) -> DataFrame:
    """Loss events as lines of the event log: severity, source and message, ordered by ``seq_no``."""
    channel = F.concat(F.lit("virtual channel "), F.col("vcid").cast("string"), F.lit(": "))
    text = (
        F.when(F.col("kind") == "frames_missing", F.concat(F.col("missing").cast("string"), F.lit(" frames missing")))
        .when(F.col("lost") > 0, F.concat(F.col("lost").cast("string"), F.lit(" packet lost, "), F.col("discarded").cast("string"), F.lit(" octets discarded")))
        .otherwise(F.concat(F.col("discarded").cast("string"), F.lit(" octets without a packet in front of them")))
    )
    time = F.col(received) if received else F.lit(None).cast("timestamp")
    return events.select(
        F.coalesce("frame_no", F.lit(-1).cast("bigint")).alias("seq_no"), time.alias("event_time"),
        F.lit(1).alias("severity"), F.lit("frame").alias("source"), F.concat(channel, text).alias("message"),
    )
