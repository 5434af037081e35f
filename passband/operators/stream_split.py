"""Back-to-back packets of a recording, split by declared length, in parallel.

Each packet only says where the next one starts, so a recording looks sequential from its first
octet to its last.  It is split in parallel all the same: chains of lengths that start at
different octets soon run into each other.  Every cell of a recording reports where each way
into it leads out (very few places, whatever the way in); the ways actually taken are strung
together over the cells of a recording, a few numbers each; then all cells are read at once.
The result is exactly that of one pass over the recording.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from passband.functions.bits import floor_div
from passband.operators.chunks import KEYS, joined_octets
from passband.operators.packets import HEADER_BYTES, LONGEST_PACKET, check_max_length

#: Octets per cell; longer than any packet, so that a packet ends in its own or the next cell.  A cell
#: is the least that a task reads: packets may be of seven octets, and what is made of them far more.
CELL = 1 << 20
#: Packets handed on at once.
BATCH_PACKETS = 10_000
#: What a step of a walk over a cell is.
WHOLE, TAIL, DROPPED = range(3)


def _step(octets: bytes, at: int, max_length: int, chunk_ends: np.ndarray) -> int:
    """Where reading goes on after the packet at ``at``; past the end where the header is cut."""
    if at + HEADER_BYTES > len(octets):
        return len(octets) + HEADER_BYTES
    declared = HEADER_BYTES + 1 + (octets[at + 4] << 8 | octets[at + 5])
    if declared > max_length:
        # Desynchronised: everything received so far is dropped, the next chunk starts afresh.
        return int(chunk_ends[np.searchsorted(chunk_ends, at + HEADER_BYTES - 1, side="right")])
    return at + declared


def _steps(octets: np.ndarray, at: np.ndarray, max_length: int, chunk_ends: np.ndarray) -> np.ndarray:
    """:func:`_step` of many places at once."""
    whole = at + HEADER_BYTES <= len(octets)
    out = np.full(len(at), len(octets) + HEADER_BYTES, dtype=np.int64)
    read = at[whole]
    declared = HEADER_BYTES + 1 + (octets[read + 4].astype(np.int64) << 8 | octets[read + 5])
    after = read + declared
    long = declared > max_length
    if long.any():
        after[long] = chunk_ends[np.searchsorted(chunk_ends, read[long] + HEADER_BYTES - 1, side="right")]
    out[whole] = after
    return out


def ways_out(
    octets: bytes, body: int, entries, max_length: int, chunk_ends: np.ndarray
) -> list[int]:
    """Where each entry leaves a cell of ``body`` octets (``octets`` sees a header further).

    Every place of the cell takes its step, and then twice as many with each round: a cell takes as many
    rounds as its longest way has binary digits, whether ways meet or stay apart.
    """
    flat, entries = np.frombuffer(octets, np.uint8), np.asarray(entries, dtype=np.int64)
    way = _steps(flat, np.arange(body), max_length, chunk_ends)
    while len(inside := np.flatnonzero(way < body)):
        way[inside] = way[way[inside]]
    out = entries.copy()
    out[entries < body] = way[entries[entries < body]]
    return out.tolist()


def _walked(
    octets: bytes, body: int, at: int, max_length: int, chunk_ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and kind of every step from ``at`` through the ``body`` of a cell, as :func:`_step` goes."""
    places, last = [at], len(octets) - HEADER_BYTES
    while at < body:
        if at > last:
            at = len(octets) + HEADER_BYTES
        else:
            declared = HEADER_BYTES + 1 + (octets[at + 4] << 8 | octets[at + 5])
            at = at + declared if declared <= max_length else _step(octets, at, max_length, chunk_ends)
        places.append(at)
    way, flat = np.array(places, dtype=np.int64), np.frombuffer(octets, np.uint8)
    begin, end = way[:-1], way[1:]
    read = begin[begin <= last]
    declared = np.zeros(len(begin), np.int64)
    declared[begin <= last] = HEADER_BYTES + 1 + (flat[read + 4].astype(np.int64) << 8 | flat[read + 5])
    kind = np.where(declared > max_length, DROPPED, np.where((declared > 0) & (end <= body), WHOLE, TAIL))
    return begin, end, kind


def cells_of(chunks: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells of ``size`` octets that also see the first header's worth of the next cell."""
    begin = F.col("offset")
    end = begin + F.length("bytes")
    peek = HEADER_BYTES - 1
    first = F.greatest(floor_div(begin - peek, size), F.lit(0))
    spread = chunks.filter(F.length("bytes") > 0).withColumn(
        "cell", F.explode(F.sequence(first, floor_div(end - 1, size)))
    )
    low = F.greatest(F.col("cell") * size, begin)
    high = F.least((F.col("cell") + 1) * size + peek, end)
    part = F.substring(F.col("bytes"), (low - begin + 1).cast("int"), (high - low).cast("int"))
    pieces = spread.filter(low < high).select(
        *keys, "cell", low.alias("_at"), part.alias("octets"), end.alias("_end"), "received"
    )
    return (
        pieces.groupBy(*keys, "cell")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "octets", "_end", "received"))).alias("_p"))
        .select(
            *keys,
            "cell",
            joined_octets(F.col("_p")).alias("octets"),
            F.col("_p._end").alias("ends"),
            F.col("_p.received").alias("stamps"),
        )
    )


def split(
    chunks: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    max_length: int = LONGEST_PACKET,
    cell: int = CELL,
) -> tuple[DataFrame, DataFrame]:
    """(packets, residuals) of recordings: keys, offset, received, bytes / lost, discarded, reason.

    ``received`` is that of the chunk that completed the packet.
    """
    check_max_length(max_length)
    if cell < LONGEST_PACKET:
        raise ValueError(f"a cell must hold the longest packet, {LONGEST_PACKET} octets")
    guarded = max_length < LONGEST_PACKET
    cells = cells_of(chunks, cell, keys)
    totals = chunks.groupBy(*keys).agg(F.max(F.col("offset") + F.length("bytes")).alias("total"))

    def local(number: int, octets, ends) -> tuple[bytes, int, np.ndarray]:
        octets = bytes(octets)
        return octets, min(cell, len(octets)), np.asarray(ends, dtype=np.int64) - number * cell

    @pandas_udf("struct<entries:array<bigint>,exits:array<bigint>>")
    def explore(numbers: pd.Series, octets: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for number, b, e in zip(numbers, octets, ends):
            b, body, e = local(number, b, e)
            if number == 0:
                entries = {0}
            else:
                entries = set(range(min(LONGEST_PACKET, body)))
            if guarded:
                entries |= {int(x) for x in e if 0 <= x < body}
            entries = sorted(entries)
            out = ways_out(b, body, entries, max_length, e)
            rows.append(
                ([x + number * cell for x in entries], [x + number * cell for x in out])
            )
        return pd.DataFrame(rows, columns=["entries", "exits"])

    explored = cells.select(*keys, "cell", explore("cell", "octets", "ends").alias("_w")).select(
        *keys, "cell", "_w.*"
    )
    # Only ways that lead out of some cell can lead into another one.
    wanted = (
        explored.select(*keys, F.explode(F.array_distinct("exits")).alias("entry"))
        .withColumn("cell", floor_div(F.col("entry"), cell))
        .groupBy(*keys, "cell")
        .agg(F.collect_set("entry").alias("wanted"))
    )

    @pandas_udf("array<struct<entry:bigint,exit:bigint>>")
    def pick(entries: pd.Series, exits: pd.Series, wanted: pd.Series) -> pd.Series:
        rows = []
        for ways, leads, into in zip(entries, exits, wanted):
            ways = np.asarray(ways, dtype=np.int64)
            into = np.asarray([0] if into is None else [0, *into], dtype=np.int64)
            at = np.flatnonzero(np.isin(ways, into))
            rows.append([{"entry": int(ways[i]), "exit": int(leads[i])} for i in at])
        return pd.Series(rows)

    ways = explored.join(wanted, [*keys, "cell"], "left").select(
        *keys, F.inline(pick("entries", "exits", "wanted"))
    )
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def string(pdf: pd.DataFrame) -> pd.DataFrame:
        leads = dict(zip(pdf["entry"], pdf["exit"]))
        at, taken = 0, []
        while at in leads:
            taken.append(at)
            at = leads[at]
        row = pdf.iloc[0]
        return pd.DataFrame({**{k: row[k] for k in keys}, "entry": taken})

    entries = (
        ways.groupBy(*keys)
        .applyInPandas(string, f"{head}, entry bigint")
        .withColumn("cell", floor_div(F.col("entry"), cell))
    )

    # Cells that Spark takes for few are not broadcast: their octets would pass the driver.  They are
    # dealt out by number: few octets are many packets, and cells are not to be merged into few tasks.
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stamps = F.col("stamps").cast("array<timestamp>").alias("stamps")
    entered = (
        cells.hint("merge")
        .join(entries, [*keys, "cell"])
        .select(*keys, "cell", "octets", "ends", stamps, "entry")
        .repartition(parts, *keys, "cell")
    )

    def told(columns: str, make) -> DataFrame:
        """``make`` of every cell as it is walked; each kind of rows walks for itself and moves nothing else."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    number = batch["cell"][i].as_py()
                    octets = batch["octets"][i].as_py()
                    ends = batch["ends"][i].values.to_numpy() - number * cell
                    body = min(cell, len(octets))
                    at = _walked(octets, body, batch["entry"][i].as_py() - number * cell, max_length, ends)
                    for values in make(number * cell, octets, body, ends, batch["stamps"][i].values, *at):
                        own = pa.array(np.full(len(next(iter(values.values()))), i))
                        mine = {k: batch[k].take(own) for k in keys}
                        yield pa.RecordBatch.from_pydict({**mine, **values})

        return entered.mapInArrow(run, f"{head}, {columns}")

    def whole(base, octets, body, ends, stamps, begin, end, kind):
        held, buffer = np.flatnonzero(kind == WHOLE), pa.py_buffer(octets)
        # packets that follow each other are one run of offsets into the octets of the cell
        for run in np.split(held, np.flatnonzero(np.diff(held) > 1) + 1):
            for part in (run[n : n + BATCH_PACKETS] for n in range(0, len(run), BATCH_PACKETS)):
                offsets = np.append(begin[part], end[part[-1]]).astype(np.int32)
                done_by = np.searchsorted(ends, end[part] - 1, side="right")
                yield {
                    "offset": pa.array(base + begin[part]),
                    "received": stamps.take(pa.array(done_by)),
                    "bytes": pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), buffer]),
                }

    def tail(base, octets, body, ends, stamps, begin, end, kind):
        for n in np.flatnonzero(kind == TAIL).tolist():
            at = int(begin[n])
            after = pa.array([base // cell + 1])
            yield {"offset": pa.array([base + at]), "_head": pa.array([octets[at:body]], pa.binary()), "cell": after}

    def dropped(base, octets, body, ends, stamps, begin, end, kind):
        lost = kind == DROPPED
        if lost.any():
            yield {"offset": pa.array(base + begin[lost]), "discarded": pa.array((end - begin)[lost])}

    inside = told("offset bigint, received timestamp, bytes binary", whole)
    heads = told("offset bigint, _head binary, cell bigint", tail)
    return _collect(inside, heads, told("offset bigint, discarded bigint", dropped), cells, totals, keys)


def _collect(
    inside: DataFrame, heads: DataFrame, dropped: DataFrame, cells: DataFrame, totals: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    # A packet over a cell boundary: its head here, the rest at the front of the next cell.
    following = cells.select(
        *keys,
        "cell",
        F.substring("octets", 1, LONGEST_PACKET).alias("_next"),
        "ends",
        "stamps",
    )
    met = heads.join(following.hint("merge"), [*keys, "cell"], "left")
    joined = F.concat("_head", F.coalesce("_next", F.unhex(F.lit(""))))
    size = F.when(
        F.length(joined) >= HEADER_BYTES,
        F.conv(F.hex(F.substring(joined, 5, 2)), 16, 10).cast("bigint") + HEADER_BYTES + 1,
    )
    last = F.col("offset") + size - 1
    straddling = met.withColumn("_size", size)
    complete = F.coalesce(F.col("_size") <= F.length(joined), F.lit(False))
    over = straddling.filter(complete).select(
        *keys,
        "offset",
        F.get("stamps", F.size(F.filter("ends", lambda e: e <= last))).alias("received"),
        F.substring(joined, F.lit(1), F.col("_size").cast("int")).alias("bytes"),
    )
    cut_off = (
        straddling.filter(~complete)
        .join(totals, list(keys))
        .select(
            *keys,
            "offset",
            F.lit(1).alias("lost"),
            (F.col("total") - F.col("offset")).alias("discarded"),
            F.lit("cut_off").alias("reason"),
        )
    )
    desync = dropped.select(
        *keys, "offset", F.lit(0).alias("lost"), "discarded", F.lit("desync").alias("reason")
    )
    return inside.unionByName(over), cut_off.unionByName(desync)
