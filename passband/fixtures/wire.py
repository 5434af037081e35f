"""Packets of the given tables laid out as frames and as a marked byte stream.

The framing jobs need octets to work on; here they are derived row by row from the packet view,
so their amount grows with the tables.  They stand for recordings that exist as files, so they
are written once (``pin``) and read by the jobs like one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from passband.fixtures import views
from passband.functions.bits import floor_div, to_octets
from passband.functions.checksum import crc16
from passband.operators import coding
from passband.operators.chunks import recut
from passband.operators.ordered import DEFAULT_WIDTH, carry
from passband.session import pin

PACKET = 11
DATA = 50
SPACECRAFT = 42
MARKER = "1ACFFC1D"
CAPTURE_KEYS = ("capture_id", "epoch")
#: Octets of a frame (header, data, checksum), and of a frame with its marker.
FRAME = 6 + DATA + 2
UNIT = 4 + FRAME
#: Octets of a code block and its check symbols.
BLOCK, PARITY = 255, 32


def packet_streams(spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Each channel's packets end to end, padded with one idle packet to whole frames."""
    packets = views.packet_bytes(spark, folder, width).select(
        (F.col("apid") % 4).alias("capture_id"),
        "epoch",
        (floor_div(F.col("apid"), 4) % 8).cast("int").alias("vcid"),
        "pkt_no",
        F.col("bytes").alias("octets"),
    )
    channel = [*CAPTURE_KEYS, "vcid"]
    numbered = carry(packets, channel, "pkt_no", sums={"_k": F.lit(1)}, width=width)
    placed = numbered.select(*channel, ((F.col("_k") - 1) * PACKET).alias("offset"), "octets")
    total = packets.groupBy(*channel).agg((F.count(F.lit(1)) * PACKET).alias("_total"))
    short = F.lit(DATA) - F.col("_total") % DATA
    pad = F.when(short < 7, short + DATA).otherwise(short)
    fill = F.concat(
        F.unhex(F.lit("0FFFC000")),
        to_octets(F.col("_pad") - 7, 2),
        F.unhex(F.repeat(F.lit("00"), (F.col("_pad") - 6).cast("int"))),
    )
    idle = total.withColumn("_pad", pad).select(
        *channel, F.col("_total").alias("offset"), fill.alias("octets")
    )
    return pin(placed.unionByName(idle))


def frames(spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Transfer frames with checksum; every 23rd is removed, so counts jump and packets break."""
    channel = [*CAPTURE_KEYS, "vcid"]
    stream = packet_streams(spark, folder, width)
    data = recut(stream, channel, DATA)
    first = stream.groupBy(*channel, floor_div(F.col("offset"), DATA).alias("cell")).agg(
        (F.min("offset") % DATA).alias("_pointer")
    )
    number = F.col("cell") * 8 + F.col("vcid")
    headed = data.join(first, [*channel, "cell"], "left").withColumn("frame_no", number)
    pointer = F.coalesce(F.col("_pointer"), F.lit(0x7FF))
    body = F.concat(
        to_octets(F.lit(SPACECRAFT << 4) + F.col("vcid") * 2, 2),
        to_octets(F.col("frame_no") % 256, 1),
        to_octets(F.col("cell") % 256, 1),
        to_octets(pointer + (3 << 11), 2),
        F.col("octets"),
    )
    kept = headed.filter(F.col("frame_no") % 23 != 7).select(
        *CAPTURE_KEYS, "frame_no", body.alias("_body")
    )
    stamped = kept.withColumn("frame", F.concat("_body", to_octets(crc16("_body"), 2)))
    return pin(
        stamped.select(
            *CAPTURE_KEYS,
            "frame_no",
            F.timestamp_seconds(F.col("frame_no")).alias("received"),
            "frame",
        )
    )


@pandas_udf(BinaryType())
def code_block(frames: pd.Series) -> pd.Series:
    """Frames, filled up with zeros, and their check symbols: remainders by the code's polynomial."""
    antilog, log, conventional = coding.field()
    dual = np.argsort(conventional)
    times = lambda a, b: np.where((a == 0) | (b == 0), 0, antilog[(log[a] + log[b]) % 255])
    product = np.array([1])
    for j in range(PARITY):
        root = antilog[coding.ROOT_SPACING * (coding.FIRST_ROOT[PARITY] + j) % 255]
        product = np.append(product, 0) ^ np.append(0, times(product, root))
    held = np.zeros((len(frames), BLOCK - PARITY), np.uint8)
    for row, frame in enumerate(frames):
        held[row, : len(frame)] = np.frombuffer(frame, np.uint8)
    symbols, rest = conventional[held], np.zeros((len(frames), PARITY), np.int64)
    for k in range(symbols.shape[1]):
        lead = symbols[:, k] ^ rest[:, 0]
        rest = np.append(rest[:, 1:], np.zeros((len(frames), 1), np.int64), axis=1) ^ times(lead[:, None], product[1:][None])
    whole = np.concatenate([held, dual[rest].astype(np.uint8)], axis=1)
    return pd.Series([row.tobytes() for row in whole])


def recording(
    spark: SparkSession, folder: str, *, randomised: bool = False, coded: bool = False
) -> DataFrame:
    """Frames with markers as one stream per capture, in chunks of 256 octets.

    With ``coded`` every frame lies in a code block, and one block in twenty-nine is damaged.

    Two markers in forty are wiped out (the flywheel bridges them), and 17 octets of noise are
    slipped in before every fortieth frame (lock is lost and found again).
    """
    recorded = frames(spark, folder)
    ranked = carry(recorded, CAPTURE_KEYS, "frame_no", sums={"_k": F.lit(1)})
    rank = F.col("_k") - 1
    marker = F.when((rank % 40).isin(10, 25), F.unhex(F.lit("00000000"))).otherwise(F.unhex(F.lit(MARKER)))
    noise = F.when((rank % 40 == 39), F.unhex(F.lit("55" * 17))).otherwise(F.unhex(F.lit("")))
    unit = 4 + BLOCK if coded else UNIT
    if coded:
        damage = F.unhex(F.concat(F.lit("00" * 30 + "5A"), F.repeat(F.lit("00"), F.lit(BLOCK - 31))))
        hit = F.when(rank % 29 == 5, damage).otherwise(F.unhex(F.lit("00" * BLOCK)))
        ranked = ranked.withColumn("frame", coding.combine(code_block("frame"), hit))
    frame = coding.derandomise("frame") if randomised else F.col("frame")
    units = ranked.select(
        *CAPTURE_KEYS,
        (rank * unit + F.floor(rank / 40) * 17).alias("offset"),
        F.concat(noise, marker, frame).alias("octets"),
    )
    cut = recut(units, CAPTURE_KEYS, 256)
    return pin(
        cut.select(
            *CAPTURE_KEYS,
            F.col("cell").alias("chunk_no"),
            F.col("start").alias("offset"),
            F.timestamp_seconds(F.col("cell")).alias("received"),
            F.col("octets").alias("bytes"),
        )
    )
