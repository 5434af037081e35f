"""Near duplicates by SimHash fingerprints, found with Golay-code fuzzy hashing (operator 4).

A 64-bit fingerprint is cut into three segments, each padded to a 23-bit word.  Three differing bits
over three segments leave two cases: one segment is equal and another differs in at most one bit, or
each differs in exactly one.  A segment that differs in at most one bit shares a codeword index with
its partner (see :mod:`golay`), so keys are

* for each ordered pair of segments, the bits of the first with an index of the second, and
* the three indices together.

One side of a pair writes the nearest index, the other up to six, so a fingerprint has some seventy
keys of 33 to 36 bits.  Rows that share a key are verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm import golay
from passband.llm.common import WORD, keyed, renamed, slices, small, stored, text_key, without
from passband.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Cells of the comparison table that is held at once for a crowded key.
CELLS = 4 << 20
#: Octets of text whose shingles are made at once.
PART = 1 << 18


def fingerprint(text: str | None) -> int:
    """Majority bits of XXH64 over the three-word shingles of the ASCII-lower-cased text.

    Shorter texts are one shingle, and texts without words have fingerprint zero.
    """
    bits, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, SHINGLE, SEED):
        part = hashes.view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    majority = np.packbits(2 * bits > total, bitorder="little")
    return int(majority.view("<u8")[0])


def shingle_hashes(text: str | None, length: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``length`` words of the ASCII-lower-cased text, in parts; the whole
    sequence is one shingle if it is shorter, and no words have none."""
    octets = (text or "").encode().lower()
    digest, held, some, at = xxhash.xxh64_intdigest, [], False, 0
    while at < len(octets):
        end = min(len(octets), at + PART)
        while end < len(octets) and octets[end] not in b" \t\n\v\f\r":  # words stay whole
            end += 1
        words = held + WORD.findall(octets[at:end])
        at = end
        if len(words) >= length:
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            yield np.array([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[length - 1 :])], "<u8")
            some, held = True, words[len(words) - length + 1 :]
        else:
            held = words
    if held and not some:
        yield np.array([digest(b" ".join(held), seed)], "<u8")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint's bits as a signed bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000, 8 << 20):
            values = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(values.view(np.int64))],
                names=["doc_id", "text_key", "fp"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        run, "doc_id bigint, text_key bigint, fp bigint"
    )


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, position and side (0 written once, 1 looked up) of all keys of unsigned fingerprints."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    index = [golay.near(p).astype(np.int64) for p in parts]
    rows = np.arange(len(fps))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    pairs = [(i, j) for i in range(3) for j in range(3) if i != j]
    for family, (i, j) in enumerate(pairs):
        head = np.int64(family) << 40 | parts[i] << 12
        out.append((head | index[j][:, 0], rows, 0))
        for c in range(6):
            ok = index[j][:, c] >= 0
            out.append((head[ok] | index[j][ok, c], rows[ok], 1))
    a, b, c = index
    head = np.int64(len(pairs)) << 40
    for x in range(6):
        ok = a[:, x] >= 0
        out.append((head | a[ok, x] << 24 | b[ok, 0] << 12 | c[ok, 0], rows[ok], 0))
        for y in range(6):
            ok = (b[:, x] >= 0) & (c[:, y] >= 0)
            out.append((head | a[ok, 0] << 24 | b[ok, x] << 12 | c[ok, y], rows[ok], 1))
    sides = np.concatenate([np.full(len(k), s, np.int64) for k, _, s in out])
    return np.concatenate([k for k, _, _ in out]), np.concatenate([r for _, r, _ in out]), sides


def bucket_links(written: np.ndarray, looked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges with the components of one key's links within ``RADIUS`` bits, one per fingerprint at most.

    All pairs are compared in blocks of bounded size, but only a spanning set is returned: each
    looked-up one with one of its partners, and each written one with the root of its group.
    """
    root = np.arange(len(written))
    step = max(1, CELLS // len(written))
    for at in range(0, len(looked), step):
        probe = looked[at : at + step]
        close = np.bitwise_count(probe[:, None] ^ written[None, :]) <= RADIUS
        touched = close.any(axis=1)
        probe, close = probe[touched], close[touched]
        if not len(probe):
            continue
        while True:  # every probe pulls the groups of its partners to the smallest of them
            least = np.where(close, root, len(written)).min(axis=1)
            pulled = np.where(close, least[:, None], len(written)).min(axis=0)
            moved = np.flatnonzero(pulled < root)
            if not len(moved):
                break
            to = np.arange(len(written))
            np.minimum.at(to, root[moved], pulled[moved])
            root = to[root]
        first = written[close.argmax(axis=1)]
        yield probe[first != probe], first[first != probe]
    hung = np.flatnonzero(root != np.arange(len(written)))
    yield written[hung], written[root[hung]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows that come sorted by key and side."""

    def emit(pairs):
        u = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
        v = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.uint64)
        u, v = np.minimum(u, v).view(np.int64), np.maximum(u, v).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def settle(key, fps, last):
        """Links of the whole buckets of sorted rows; what is left of the last one, unless it ends here."""
        bucket = key >> 1
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts = np.concatenate([[0], cuts])
        if not last:
            whole, rest = starts[:-1], starts[-1]
        else:
            whole, rest = starts, len(key)
        pairs = []
        if len(whole):
            ends = np.append(starts[1:], len(key))[: len(whole)]
            low = np.minimum.reduceat(fps[:rest], whole)
            high = np.maximum.reduceat(fps[:rest], whole)
            mixed = (low != high) & (key[whole] & 1 == 0)  # more than one, and a written one
            for a, b in zip(whole[mixed].tolist(), ends[mixed].tolist()):
                split = a + int(np.searchsorted(key[a:b] & 1, 1))
                pairs += bucket_links(fps[a:split], fps[split:b])
        return pairs, key[rest:], fps[rest:]

    key, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    waiting: list[pa.RecordBatch] = []
    held = 0

    def join():
        nonlocal key, fps
        key = np.concatenate([key, *(b["key"].to_numpy() for b in waiting)])
        fps = np.concatenate([fps, *(b["fp"].to_numpy().view(np.uint64) for b in waiting)])

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.num_rows
        if held >= 200_000 + len(key):  # grows with a crowded key, so that it is not copied each time
            join()
            waiting, held = [], 0
            pairs, key, fps = settle(key, fps, last=False)
            yield emit(pairs)
    join()
    if len(key):
        yield emit(settle(key, fps, last=True)[0])


def links(distinct: DataFrame) -> DataFrame:
    """u, v: edges over distinct fingerprints (``fp``) with the components of all links within ``RADIUS``.

    An edge joins two that are linked, or two that are linked to the same ones under a common key.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                fps = batch["fp"].slice(at, 2_000).to_numpy().view(np.uint64)
                key, rows, side = keys(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key << 1 | side), pa.array(fps[rows].view(np.int64))], names=["key", "fp"]
                )

    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fp").mapInArrow(spread, "key bigint, fp bigint")
    return (
        rows.repartition(parts, F.shiftright("key", 1))
        .sortWithinPartitions("key")
        .mapInArrow(_links, "u bigint, v bigint")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, root (the same within a group), component_id (smallest doc_id) per row.

    Exact copies and other equal fingerprints are brought together before keys are made.  Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows keep one row
    each; a group whose doc_ids are all null has a null component_id.
    """
    prints = stored(fingerprints(docs))
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups))
    member = stored(
        groups.join(roots, groups.fp == roots.node, "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
    )
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    mapping = small(stored(member.join(named, "root").select("fp", "root", "component_id")), 32)
    return prints.join(mapping, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id.

    Rows without a doc_id come after all others.  Where the chosen row is there several times, one
    of them stays.
    """
    return chosen_ones(docs, near_duplicates(docs))


def chosen_ones(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each root of ``groups`` (doc_id, text_key, root of every row)."""
    found = stored(groups)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = found.groupBy("root").agg(F.min(order).alias("row"))
    placed = stored(
        found.join(small(stored(chosen), 48), "root").select(
            "doc_id",
            "text_key",
            (F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("text_key") == F.col("row.text_key"))).alias("stays"),
        )
    )
    kept = without(docs, placed.filter(~F.col("stays")))
    repeated = stored(
        placed.filter("stays").groupBy("doc_id", "text_key").count().filter("count > 1").drop("count")
    )
    if repeated.isEmpty():
        return kept
    once = without(kept, repeated)
    again = small(stored(renamed(repeated)), 32)
    twice = kept.join(again, keyed(kept, again), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice)
