"""Sync markers in a recording: scan, strides, frame-length advice, frame cut.

A recording is a table of chunks (capture_id, epoch, chunk_no, offset, bytes) whose offsets are
contiguous.  Octets are searched where they lie; only what crosses a seam is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from passband.functions.bits import floor_div
from passband.operators.chunks import cut
from passband.operators.ordered import carry
from passband.session import pin

KEYS = ("capture_id", "epoch")

# The attached sync marker, tolerated misses, coded and candidate lengths.
MARKER = bytes.fromhex("1ACFFC1D")
FLYWHEEL = 4
CODEWORD = 255
INTERLEAVE_DEPTHS = (1, 2, 3, 4, 5, 8)
FRAME_LENGTH_CANDIDATES = (1115, 1279, 2048, 892)


def shifted(marker: bytes, bit: int) -> tuple[bytes, bytes]:
    """The marker ``bit`` bits into an octet, and the mask of the bits it occupies."""
    width = len(marker) + (1 if bit else 0)
    room = 8 * width - 8 * len(marker) - bit
    value = int.from_bytes(marker, "big") << room
    mask = ((1 << (8 * len(marker))) - 1) << room
    return value.to_bytes(width, "big"), mask.to_bytes(width, "big")


def find_marker(octets: bytes, marker: bytes, bits: Sequence[int]) -> list[int]:
    """Bit positions of every occurrence, overlapping ones included."""
    found = []
    for bit in bits:
        value, mask = shifted(marker, bit)
        # The octets fully inside the marker are searched for; the two ends are compared masked.
        low, high = (0, len(value)) if bit == 0 else (1, len(value) - 1)
        core = value[low:high]
        at = octets.find(core)
        while at >= 0:
            start = at - low
            window = octets[start : start + len(value)] if start >= 0 else b""
            if len(window) == len(value) and all(
                w & m == v for w, m, v in zip(window, mask, value)
            ):
                found.append(8 * start + bit)
            at = octets.find(core, at + 1)
    return sorted(found)


def first_marker(octets: bytes, start: int, marker: bytes, bits: Sequence[int]) -> int | None:
    """Bit position of the first occurrence from octet ``start`` on; no further octets are searched."""
    best: int | None = None
    for bit in bits:
        value, mask = shifted(marker, bit)
        low, high = (0, len(value)) if bit == 0 else (1, len(value) - 1)
        core = value[low:high]
        stop = len(octets) if best is None else best // 8 + len(value)
        at = octets.find(core, start + low, stop)
        while at >= 0:
            begin = at - low
            window = octets[begin : begin + len(value)]
            if len(window) == len(value) and all(w & m == v for w, m, v in zip(window, mask, value)):
                place = 8 * begin + bit
                best = place if best is None else min(best, place)
                break
            at = octets.find(core, at + 1, stop)
    return best


#: Offsets per cell in which the edges of chunks are brought together.
SEAM_CELL = 4096


def seam_markers(
    begin: int, lows: list[int], chunk_at: list[int], parts: list[bytes], marker: bytes, bits: Sequence[int]
) -> list[int]:
    """Bit positions of markers over a seam that begin in the cell at octet ``begin``.

    ``parts`` are edges of chunks in order; where one does not follow the other at once,
    the octets between lie inside a chunk and no marker over a seam spans them.
    """
    found: list[int] = []
    i = 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and lows[j] == lows[j - 1] + len(parts[j - 1]):
            j += 1
        seams = [lows[k] for k in range(i + 1, j) if lows[k] == chunk_at[k]]
        if seams:
            for at in find_marker(b"".join(parts[i:j]), marker, bits):
                pos = lows[i] + at // 8
                end = pos + len(marker) + (1 if at % 8 else 0)
                if begin <= pos < begin + SEAM_CELL and any(pos < s < end for s in seams):
                    found.append(8 * pos + at % 8)
        i = j
    return found


def scan(
    chunks: DataFrame,
    marker: bytes = MARKER,
    *,
    bit_slip: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Every marker, each once, chunk seams included: keys, ``pos`` (octet), ``bit``.

    Chunks are searched in place.  A marker over a seam lies within the last and first few
    octets of neighbouring chunks; only those are brought together, in cells of offsets, so chunks
    may be as short as one octet.
    """
    bits = range(8) if bit_slip else range(1)
    reach = len(marker) - 1 + (1 if bit_slip else 0)

    @pandas_udf("array<bigint>")
    def find(octets: pd.Series) -> pd.Series:
        return octets.map(lambda b: find_marker(bytes(b), marker, bits))

    def placed(pieces: DataFrame) -> DataFrame:
        at = F.explode(find("bytes")).alias("_at")
        return pieces.select(*keys, "offset", at).select(
            *keys,
            (F.col("offset") + floor_div(F.col("_at"), 8)).alias("pos"),
            (F.col("_at") % 8).cast("int").alias("bit"),
        )

    inside = placed(chunks)
    if reach == 0:
        return inside
    size = F.length("bytes")
    begin = F.col("offset")

    def piece(low: Column, octets: Column) -> Column:
        return F.struct(low.alias("low"), octets.alias("octets"))

    # The first and last octets of a chunk; all of a short one.
    head, tail = F.substring("bytes", 1, reach), F.substring(F.col("bytes"), size - reach + 1, F.lit(reach))
    pieces = chunks.filter(size > 0).select(
        *keys,
        F.col("offset").alias("chunk_at"),
        F.explode(
            F.when(size <= 2 * reach, F.array(piece(begin, F.col("bytes")))).otherwise(
                F.array(piece(begin, head), piece(begin + size - reach, tail))
            )
        ).alias("_p"),
    )
    # A cell needs what markers that begin in it may reach.
    low, high = F.col("_p.low"), F.col("_p.low") + F.length("_p.octets")
    spread = pieces.withColumn(
        "cell", F.explode(F.sequence(floor_div(low - reach, SEAM_CELL), floor_div(high - 1, SEAM_CELL)))
    )
    cells = spread.groupBy(*keys, "cell").agg(
        F.sort_array(F.collect_list(F.struct("_p.low", "chunk_at", "_p.octets"))).alias("_s")
    )
    cells = cells.filter(F.size("_s") > 1)

    @pandas_udf("array<bigint>")
    def across(cell: pd.Series, lows: pd.Series, chunk_at: pd.Series, octets: pd.Series) -> pd.Series:
        return pd.Series(
            [
                seam_markers(c * SEAM_CELL, list(at), list(starts), [bytes(b) for b in parts], marker, bits)
                for c, at, starts, parts in zip(cell, lows, chunk_at, octets)
            ]
        )

    at = F.explode(across("cell", F.col("_s.low"), F.col("_s.chunk_at"), F.col("_s.octets"))).alias("_at")
    crossing = cells.select(*keys, at).select(
        *keys, floor_div(F.col("_at"), 8).alias("pos"), (F.col("_at") % 8).cast("int").alias("bit")
    )
    return inside.unionByName(crossing)


def strides(
    markers: DataFrame, keys: Sequence[str] = KEYS, *, width: int = 1 << 32
) -> DataFrame:
    """How often each distance between neighbouring markers occurs, per recording.

    ``width`` is in octets here: a slice holds the markers of that much recording.
    """
    stepped = carry(markers.filter(F.col("bit") == 0), keys, "pos", previous={"_before": "pos"}, width=width)
    return (
        stepped.filter(F.col("_before").isNotNull())
        .groupBy(*keys, (F.col("pos") - F.col("_before")).alias("stride"))
        .agg(F.count(F.lit(1)).alias("intervals"))
    )


def modal_stride(histogram: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The most common stride (ties: the smallest) and how many intervals there are in all."""
    return histogram.groupBy(*keys).agg(
        F.max_by("stride", F.struct("intervals", -F.col("stride"))).alias("stride"),
        F.max("intervals").alias("intervals"),
        F.sum("intervals").alias("total"),
    )


def advice(modal: DataFrame, marker_bytes: int = len(MARKER)) -> DataFrame:
    """What a modal stride says about the frames: coded or not, interleaving, frame lengths."""
    block = F.col("stride") - marker_bytes
    depth = floor_div(block, CODEWORD)
    coded = (block > 0) & (block % CODEWORD == 0) & depth.isin(*INTERLEAVE_DEPTHS)
    kind = F.when(block <= 0, "not_frames").when(coded, "coded").otherwise("uncoded")
    return modal.withColumns(
        {
            "kind": kind,
            "interleave": F.when(coded, depth),
            "frame_length": F.when(coded, depth * (CODEWORD - 32)).when(block > 0, block),
            "frame_length_e8": F.when(coded, depth * (CODEWORD - 16)),
            "consistent": F.col("intervals") * 2 >= F.col("total"),
        }
    )


def candidate_hits(
    histogram: DataFrame,
    keys: Sequence[str] = KEYS,
    candidates: Sequence[int] = FRAME_LENGTH_CANDIDATES,
    marker_bytes: int = len(MARKER),
) -> DataFrame:
    """Intervals at each common frame length, bare and with the marker counted in."""

    def hits(length: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stride") == length, F.col("intervals"))), F.lit(0))

    pairs = [
        F.struct(
            F.lit(c).alias("candidate"), hits(c).alias("bare"), hits(c + marker_bytes).alias("with_marker")
        )
        for c in candidates
    ]
    return histogram.groupBy(*keys).agg(F.array(*pairs).alias("_c")).select(*keys, F.inline("_c"))


# ----------------------------------------------------------------------------------- frame cut

def _next(marks: np.ndarray, frame_bits: int, flywheel: int) -> np.ndarray:
    """Index of the marker a lock at each marker passes to next (len(marks) where unknown).

    Locked at m, frames follow at m + k stride.  The nearest of the tolerated places that holds
    a marker renews the lock; with none, the search starts where the first untolerated marker
    should have been, at the first octet of that place.
    """
    count = len(marks)
    out = np.full(count, -1, dtype=np.int64)
    for k in range(1, flywheel + 2):
        want = marks + k * frame_bits
        at = np.searchsorted(marks, want)
        hit = (at < count) & (marks[np.minimum(at, count - 1)] == want)
        out = np.where((out < 0) & hit, at, out)
    search = (marks + (flywheel + 1) * frame_bits) // 8 * 8
    return np.where(out < 0, np.searchsorted(marks, search), out)


def frame_starts(
    markers: DataFrame,
    totals: DataFrame,
    frame_length: int,
    *,
    marker_bytes: int = len(MARKER),
    flywheel: int = FLYWHEEL,
    keys: Sequence[str] = KEYS,
    slice_octets: int = 1 << 26,
) -> DataFrame:
    """Frames by lock and flywheel: keys, ``start`` (octet behind the marker), ``bit``,
    ``found`` (marker seen, not assumed) and ``lock`` (position of the lock it belongs to).

    ``totals`` holds keys and ``total``, the length of each recording.  The walk from lock to
    lock is sequential, but where it goes from a marker depends only on the markers ahead.  So
    every slice of a recording first reports where each way into it leads out; the ways are
    strung together over slices (a few rows each); then all slices are walked at once.
    """
    if frame_length < 1:
        raise ValueError("frame_length must be at least 1")
    stride = marker_bytes + frame_length
    bits = 8 * stride
    ahead = (flywheel + 1) * stride + 1
    if slice_octets < 2 * ahead:
        raise ValueError("a slice must be longer than twice what the flywheel can bridge")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in markers.schema if f.name in keys)

    marks = markers.select(
        *keys, (F.col("pos") * 8 + F.col("bit")).alias("mark"), floor_div(F.col("pos"), slice_octets).alias("_slice")
    )
    # What a slice has to see of the markers behind its end: those a lock can jump to, and the
    # first one a search can find, however far away.
    within = F.col("mark") < (F.col("_slice") * slice_octets + ahead) * 8
    near = marks.filter(within).select(*keys, "mark", (F.col("_slice") - 1).alias("_slice"))
    firsts = marks.groupBy(*keys, "_slice").agg(
        F.min("mark").alias("_first"), F.min(F.when(~within, F.col("mark"))).alias("_far")
    )
    order = Window.partitionBy(*keys).orderBy("_slice")
    later = F.min("_first").over(order.rowsBetween(2, Window.unboundedFollowing))
    contiguous = F.lead("_slice").over(order) == F.col("_slice") + 1
    beyond = F.when(
        contiguous, F.coalesce(F.lead("_far").over(order), later)
    ).otherwise(F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)))
    far = firsts.select(*keys, beyond.alias("mark"), "_slice").filter(F.col("mark").isNotNull())
    home = marks.withColumn("_own", F.lit(True))
    halo = near.unionByName(far).withColumn("_own", F.lit(False))
    # A halo row that lands in a slice without markers of its own is never walked from.
    around = home.unionByName(halo)

    def trace(own: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = _next(every, bits, flywheel)
        return step, np.append(every, -1)[step]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.unique(pdf["mark"].to_numpy())
        own = np.unique(pdf.loc[pdf["_own"], "mark"].to_numpy())
        empty = pdf.iloc[:0][[*keys, "_slice"]].assign(entry=pd.Series(dtype="int64"), exit=pd.Series(dtype="int64"))
        if not len(own):
            return empty
        step, goes = trace(own, every)
        leads = np.full(len(every) + 1, -1, dtype=np.int64)
        inside = np.isin(every, own)
        for i in range(len(every) - 1, -1, -1):
            if inside[i]:
                nxt = step[i]
                leads[i] = leads[nxt] if nxt < len(every) and inside[nxt] else goes[i]
        at = np.searchsorted(every, own)
        row = pdf.iloc[0]
        return pd.DataFrame({**{k: row[k] for k in keys}, "_slice": row["_slice"], "entry": own, "exit": leads[at]})

    exit_rows = pin(
        around.groupBy(*keys, "_slice").applyInPandas(
            exits, f"{key_schema}, _slice bigint, entry bigint, exit bigint"
        )
    )
    # Ways that can be taken: into the first marker of a recording, and out of any slice.
    opening = marks.groupBy(*keys).agg(F.min("mark").alias("entry"))
    taken = (
        exit_rows.select(*keys, F.col("exit").alias("entry")).filter(F.col("entry") >= 0).unionByName(opening).distinct()
    )
    ways = exit_rows.join(taken, [*keys, "entry"])

    def string(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        leads = dict(zip(pdf["entry"], pdf["exit"]))
        homes = dict(zip(pdf["entry"], pdf["_slice"]))
        at, out = int(pdf["entry"].min()), []
        while at in leads:
            out.append((homes[at], at))
            at = leads[at]
        row = pdf.iloc[0]
        return pd.DataFrame(
            {**{k: row[k] for k in keys}, "_slice": [o[0] for o in out], "entry": [o[1] for o in out]}
        )

    entries = ways.groupBy(*keys).applyInPandas(string, f"{key_schema}, _slice bigint, entry bigint")
    # The length of the recording joins the few entries, not the many markers.
    entered = entries.join(totals.select(*keys, "total"), list(keys))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.unique(pdf["mark"].to_numpy())
        own = set(pdf.loc[pdf["_own"], "mark"])
        step, goes = trace(every, every)
        index = {m: i for i, m in enumerate(every)}
        row = pdf.iloc[0]
        at, total = int(row["entry"]), int(row["total"])
        start, found, renewed, bit = [], [], [], []
        while at in own:
            nxt = int(goes[index[at]])
            hops = (nxt - at) // bits if nxt >= 0 and (nxt - at) % bits == 0 else flywheel + 1
            straddle = 1 if at % 8 else 0
            for k in range(min(hops, flywheel + 1)):
                begin = at // 8 + k * stride
                if begin + stride + straddle > total:
                    break
                start.append(begin + marker_bytes)
                found.append(k == 0)
                bit.append(at % 8)
                renewed.append(at // 8)
            at = nxt
        return pd.DataFrame(
            {**{k: row[k] for k in keys}, "start": start, "bit": bit, "found": found, "lock": renewed}
        )

    walked = (
        around.join(entered, [*keys, "_slice"])
        .groupBy(*keys, "_slice")
        .applyInPandas(walk, f"{key_schema}, start bigint, bit int, found boolean, lock bigint")
    )
    return walked


def align(frame: Column, bit: Column) -> Column:
    """Shift octets left by a bit offset; the row carries one octet more than it yields."""

    @pandas_udf("binary")
    def shift(octets: pd.Series, bits: pd.Series) -> pd.Series:
        held = [np.frombuffer(b, np.uint8).astype(np.uint16) for b in octets]
        # two neighbouring octets hold every shifted one
        return pd.Series(
            [
                b.astype(np.uint8).tobytes() if n == 0 else ((b[:-1] << n | b[1:] >> (8 - n)) & 255).astype(np.uint8).tobytes()
                for b, n in zip(held, bits.tolist())
            ]
        )

    return shift(frame, bit)


def cut_frames(
    cells: DataFrame, starts: DataFrame, frame_length: int, size: int, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Byte-aligned frames at the places :func:`frame_starts` found, numbered by position."""
    ranges = starts.withColumn(
        "length", F.lit(frame_length) + F.when(F.col("bit") > 0, 1).otherwise(0)
    )
    raw = cut(cells, ranges, size, keys=keys, carried=["bit", "found", "lock"])
    return raw.select(
        *keys, F.col("start").alias("frame_no"), "found", "lock", align(F.col("octets"), F.col("bit")).alias("frame")
    )


def sync_counters(
    starts: DataFrame,
    totals: DataFrame,
    frame_length: int,
    *,
    marker_bytes: int = len(MARKER),
    flywheel: int = FLYWHEEL,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """bytes_in, sync_found and sync_lost per recording, from what :func:`frame_starts` found.

    Lock was lost between two markers that are no whole number of frames apart, or more than the
    flywheel bridges; and at the end of a recording that goes on for longer than that.
    """
    stride = marker_bytes + frame_length
    most = (flywheel + 1) * stride
    seen = starts.filter("found").select(*keys, ((F.col("start") - marker_bytes) * 8 + F.col("bit")).alias("_mark"))
    step = F.col("_mark") - F.col("_before")
    held = (step % (8 * stride) == 0) & (step <= 8 * most)
    between = (
        carry(seen, keys, "_mark", previous={"_before": "_mark"})
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("sync_found"),
            F.count(F.when(F.col("_before").isNotNull() & ~held, 1)).alias("_lost"),
            F.max("_mark").alias("_last"),
        )
    )
    bridged = F.ceil(F.col("_last") / 8).cast("bigint") + most + stride
    joined = totals.select(*keys, "total").join(between, list(keys), "left")
    return joined.select(
        *keys,
        F.col("total").alias("bytes_in"),
        F.coalesce("sync_found", F.lit(0)).alias("sync_found"),
        (F.coalesce("_lost", F.lit(0)) + F.when(bridged <= F.col("total"), 1).otherwise(0)).alias("sync_lost"),
    )
