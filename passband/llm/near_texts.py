"""Near-duplicate texts: wide SimHash fingerprints, Golay keys, and an exact Jaccard check.

The settings of :mod:`simhash` find texts that differ in a few words.  A stage that promises a Jaccard
similarity of 0.8 over five-word shingles needs a wider radius: such texts differ in an eighth of all
bits.  So the fingerprint has twelve segments of 23 bits, made from two-word shingles, which a changed
word touches least.  Each segment is decoded to its nearest Golay codeword, and every pair of indices
is a key: texts meet if errors leave two of twelve segments with the same codeword (pigeonhole).  Rows
of a key leave the minimum spanning tree of their distances, edges within ``RADIUS`` only, so that no
partner within a smaller distance is cut off.  Edges are then checked by the shingles themselves.

Keys miss a tenth of the texts just above the similarity.  So texts of different groups are compared
once more, by the prefixes of their shingle sets (:mod:`prefix_links`), which leave no link out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm import golay, prefix_links
from passband.llm.common import keyed, renamed, slices, small, stored, text_key
from passband.llm.components import components
from passband.llm.simhash import SEED, chosen_ones, shingle_hashes

SEGMENTS, WIDTH = 12, golay.LENGTH
#: 64-bit words of a fingerprint, one XXH64 seed each.
WORDS = -(-SEGMENTS * WIDTH // 64)
FEATURE, SHINGLE = 2, 5
#: Differing bits of an edge: texts at Jaccard 0.8 differ in 39 at most in 99 of 100 cases, others in a hundred and more.
RADIUS = 50
#: Rows of a key that are compared by one task; a crowded key is dealt to blocks of so many, and each
#: pair of blocks is compared.
BLOCK = 512
#: The node of all texts without words.
NO_WORDS = 0


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits out of 64-bit hashes: odd multiples, their high bits folded in."""
    if not k:
        return hashes
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def fingerprint(text: str | None) -> bytes | None:
    """Majority bits of the hashes of all two-word shingles, repeats included; None without words."""
    bits, total = np.zeros((WORDS, 64), np.int64), 0
    for hashes in shingle_hashes(text, FEATURE, SEED):
        total += len(hashes)
        for k in range(WORDS):
            part = remixed(hashes, k).view(np.uint8).reshape(-1, 8)
            bits[k] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not total:
        return None
    majority = (2 * bits > total).ravel()
    majority[SEGMENTS * WIDTH :] = False
    return np.packbits(majority, bitorder="little").tobytes()


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the five-word shingles, sorted."""
    parts = list(shingle_hashes(text, SHINGLE, SEED))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, "<u8")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, fp of every row; texts without words are one node, without fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000, 4 << 20):
            made = [fingerprint(t) for t in batch["text"].to_pylist()]
            node = [NO_WORDS if f is None else k for f, k in zip(made, batch["text_key"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(node, pa.int64()), pa.array(made, pa.binary())],
                names=["doc_id", "text_key", "node", "fp"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        run, "doc_id bigint, text_key bigint, node bigint, fp binary"
    )


def keys(fps: np.ndarray) -> np.ndarray:
    """Keys of fingerprints (rows of ``WORDS`` unsigned words): one per pair of segments."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, : SEGMENTS * WIDTH]
    words = bits.reshape(len(fps), SEGMENTS, WIDTH).astype(np.int32) @ (1 << np.arange(WIDTH, dtype=np.int32))
    index = golay.near(words.ravel())[:, 0].reshape(len(fps), SEGMENTS).astype(np.int64)
    return np.stack([k << 24 | index[:, i] << 12 | index[:, j] for k, (i, j) in enumerate(combinations(range(SEGMENTS), 2))], axis=1)


def tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the minimum spanning tree of distances, those within ``RADIUS`` only."""
    n = len(fps)
    least, parent, outside = np.full(n, 1 << 30), np.zeros(n, np.int64), np.ones(n, bool)
    ends, at = [], 0
    outside[0] = False
    for _ in range(n - 1):
        distance = np.bitwise_count(fps ^ fps[at]).sum(axis=1)
        nearer = outside & (distance < least)
        least[nearer], parent[nearer] = distance[nearer], at
        at = int(np.where(outside, least, 1 << 31).argmin())
        outside[at] = False
        if least[at] <= RADIUS:
            ends.append((int(parent[at]), at))
    pairs = np.array(ends, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _spread(nodes: DataFrame, full: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                raw = part["fp"].to_pylist()
                table = keys(np.frombuffer(b"".join(raw), "<u8").reshape(-1, WORDS))
                columns = {"key": pa.array(table.ravel())}
                if full:
                    rows = pa.array(np.repeat(np.arange(len(raw)), table.shape[1]))
                    columns |= {"node": part["node"].take(rows), "fp": part["fp"].take(rows)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return nodes.select("node", "fp").mapInArrow(run, "key bigint, node bigint, fp binary" if full else "key bigint")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows that come sorted by group; a group has two blocks of rows at most, or about."""
    group, node, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WORDS), np.uint64)

    def edges(group: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, np.diff(group) != 0))
        sizes = np.diff(np.append(starts, len(group)))
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1) <= RADIUS]
        u, v = [node[near]], [node[near + 1]]
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            i, j = tree(fp[a : a + n])
            u.append(node[a + i])
            v.append(node[a + j])
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.concatenate([group, batch["group"].to_numpy()])
        node = np.concatenate([node, batch["node"].to_numpy()])
        fp = np.concatenate([fp, np.frombuffer(b"".join(batch["fp"].to_pylist()), "<u8").reshape(-1, WORDS)])
        last = int(np.searchsorted(group, group[-1]))  # the last group may go on
        if last:
            yield edges(group[:last], node[:last], fp[:last])
            group, node, fp = group[last:], node[last:], fp[last:]
    if len(group):
        yield edges(group, node, fp)


def candidates(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: pairs of nodes that share a key and are within ``RADIUS`` bits, a spanning tree per key."""
    crowded = stored(_spread(nodes, False).groupBy("key").count().filter(F.col("count") > block))
    crowded = crowded.select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    rows = _spread(nodes, True).join(small(crowded, 24), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a row of a crowded key is in every pair of blocks that its own block is in
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.withColumn("own", own).select("*", other.alias("other"))
    pair = F.when(F.col("parts") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    )
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.select(pair.alias("group"), "node", "fp")
    return grouped.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_trees, "u bigint, v bigint")


def similar(edges: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (u, v) whose texts have a Jaccard similarity of four fifths or more.

    Only texts of nodes with an edge are read again, one row of each, and only hashes of their
    shingles move.
    """
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    wanted = stored(renamed(nodes.join(ends, "node").select(F.col("least").alias("doc_id"), "text_key")))
    wanted = small(wanted, 32)
    read = docs.join(wanted, keyed(docs, wanted), "left_semi").select(text_key(docs["text"]).alias("node"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000, 2 << 20):
            sets = [shingle_set(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = stored(read.mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"]))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch["u_set"], batch["v_set"]):
                a, b = (np.frombuffer(x.as_py(), "<u8") for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(5 * both >= 4 * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return edges.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_set", "v_set").mapInArrow(check, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, root (the same within a group) of every row.

    Texts link if their sets of five-word shingles (ASCII-lower-cased; fewer words: the whole
    sequence) have a Jaccard similarity of 0.8 or more; all texts without words link with each other.
    """
    prints = stored(fingerprints(docs))
    nodes = stored(
        prints.filter("fp IS NOT NULL").groupBy("node", "text_key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"))
    )
    edges = stored(candidates(nodes).distinct())
    roots = stored(components(stored(similar(edges, docs, nodes))))
    rest = stored(prefix_links.candidates(docs, shingle_set, roots))
    links = stored(similar(rest, docs, nodes))
    if not links.isEmpty():
        known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = stored(components(known.unionByName(links)))
    held = small(roots, 16)
    joined = prints.join(held, "node", "left")
    return joined.select("doc_id", "text_key", F.coalesce("root", prints["node"]).alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id.

    Rows without a doc_id come after all others.  Where the chosen row is there several times, one
    of them stays.
    """
    return chosen_ones(docs, near_duplicates(docs))
