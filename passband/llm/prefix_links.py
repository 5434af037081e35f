"""Candidates of a Jaccard similarity of four fifths or more, none left out, by prefix filtering.

Every set of hashes is ordered alike: hashes seldom met come first, those met often last.  If two sets
of sizes s <= t are similar, their first common hash is within the first s // 9 + 1 places of the
smaller and the first t // 5 + 1 of the larger one, and as many follow it in both as the similarity
needs.  So rows (hash, set) of these prefixes meet by hash, and a pair is a candidate if some common
hash meets these bounds.  Any order finds all pairs; the counts it is made from only keep groups small.
Pairs of the same known group are not asked for.  What passes is held against parity bitmaps of the
whole sets: two sets differ in at least as many hashes as their bitmaps in bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm.common import slices, small, stored, text_key

#: Hashes among which repeated ones are counted, and how many of the most frequent have a place in the order.
WINDOW, FREQUENT = 1 << 21, 1 << 18
#: Hashes counted as often are looked at before they are dealt to tasks.
CROWDED = 1_000
#: Rows of a hash that are compared by one task, or about; more are dealt to blocks, and each pair of
#: blocks is compared.
BLOCK = 4_096
#: Pairs that are compared at once, and rows of a group up to which many groups are compared together.
CELLS, LITTLE = 1 << 19, 64
#: Binary logarithms of the least and the greatest number of bits of a bitmap.
LEAST, GREATEST = 6, 16

Sets = Callable[[str | None], np.ndarray]


def frequent(docs: DataFrame, sets: Sets) -> DataFrame:
    """token, n: the hashes met most often, by their repeats within windows of ``WINDOW`` hashes."""

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in slices(batches, "text", 1_000, 2 << 20):
            for text in batch["text"].to_pylist():
                held.append(sets(text))
                total += len(held[-1])
                if total >= WINDOW:
                    yield repeated(held)
                    held, total = [], 0
        if held:
            yield repeated(held)

    found = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "token").limit(FREQUENT)


def parities(found: np.ndarray) -> bytes:
    """Per value of the low bits whether an odd number of hashes has it, two to four bits a hash."""
    width = min(max((2 * len(found) - 1).bit_length(), LEAST), GREATEST)
    count = np.bincount((found & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
    return np.packbits(count & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded to the length of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (a, b)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def prefixes(docs: DataFrame, sets: Sets, often: DataFrame) -> DataFrame:
    """node, size, bits, tokens: the first ``size // 5 + 1`` hashes of every text with words, in order."""
    told = often.toArrow()
    tokens, n = told["token"].to_numpy().view(np.uint64), told["n"].to_numpy()
    by = np.argsort(tokens)
    shipped = docs.sparkSession.sparkContext.broadcast((tokens[by], n[by]))

    def first(found: np.ndarray) -> np.ndarray:
        tokens, n = shipped.value
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
            # hashes come sorted, so that equal counts are ordered by hash
            found = found[np.argsort(np.where(tokens[at] == found, n[at], 0), kind="stable")]
        return found[: len(found) // 5 + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000, 2 << 20):
            made = [sets(t) for t in batch["text"].to_pylist()]
            some = np.flatnonzero([len(s) > 0 for s in made])
            heads = [first(made[i]) for i in some]
            ends = np.cumsum([0, *map(len, heads)])
            flat = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["node"].take(pa.array(some)),
                    pa.array([len(made[i]) for i in some], pa.int32()),
                    pa.array([parities(made[i]) for i in some], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["node", "size", "bits", "tokens"],
            )

    return docs.select(text_key(docs["text"]).alias("node"), docs["text"].alias("text")).mapInArrow(
        run, "node bigint, size int, bits binary, tokens array<bigint>"
    )


def close(s: np.ndarray, i: np.ndarray, t: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes s and t can be similar if their first common hash is at places i and j."""
    less, more = np.minimum(s, t), np.maximum(s, t)
    after = 1 + np.minimum(s - i - 1, t - j - 1)
    return (5 * less >= 4 * more) & (np.where(s <= t, i, j) <= less // 9) & (9 * after >= 4 * (s + t))


def _compared(group: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Candidates among rows sorted by group; only pairs of different roots are looked at."""
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def look(i: np.ndarray, j: np.ndarray) -> None:
        ok = root[i] != root[j]
        i, j = i[ok], j[ok]
        ok = close(size[i], place[i], size[j], place[j])
        u.append(node[i[ok]])
        v.append(node[j[ok]])

    starts = np.flatnonzero(np.append(True, np.diff(group) != 0))
    counts = np.diff(np.append(starts, len(group)))
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    starts, counts = starts[mixed], counts[mixed]
    for m in np.unique(counts[counts <= LITTLE]).tolist():
        i, j = np.triu_indices(m, 1)
        same = starts[counts == m]
        step = max(1, CELLS // len(i))
        for at in range(0, len(same), step):
            some = same[at : at + step, None]
            look((some + i).ravel(), (some + j).ravel())
    for start, m in zip(starts[counts > LITTLE].tolist(), counts[counts > LITTLE].tolist()):
        _, which, many = np.unique(root[start : start + m], return_inverse=True, return_counts=True)
        others = start + np.flatnonzero(which != many.argmax())  # every pair of two roots has one of these
        step = max(1, CELLS // m)
        for at in range(0, len(others), step):
            some = others[at : at + step]
            look(np.repeat(some, m), np.tile(np.arange(start, start + m), len(some)))
    u, v = np.concatenate(u), np.concatenate(v)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["group", "node", "root", "size", "place"]
    held = [np.empty(0, np.int64) for _ in names]
    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate([h, batch[c].to_numpy().astype(np.int64)]) for h, c in zip(held, names)]
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
        if last:
            yield _compared(*(h[:last] for h in held))
            held = [h[last:] for h in held]
    if len(held[0]):
        yield _compared(*held)


def _parts(rows: DataFrame, often: DataFrame, crowded: int, block: int) -> DataFrame:
    """token, parts: blocks of the frequent hashes; 0 if all rows of a hash are of one root."""
    asked = often.filter(F.col("n") >= crowded).select("token")
    found = rows.join(small(asked, 16), "token").groupBy("token", "root").count()
    found = found.groupBy("token").agg(F.sum("count").alias("all"), F.max("count").alias("most"))
    # pairs of different roots are as many at most
    pairs = (F.col("all") - F.col("most")) * F.col("all").cast("double")
    return stored(found.select("token", F.ceil(F.sqrt(pairs) / block).cast("int").alias("parts")))


def _apart(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs whose bitmaps differ in no more bits than similar sets do."""
    ends = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    marks = stored(heads.join(small(ends, 8), "node", "left_semi").select("node", "size", "bits").dropDuplicates(["node"]))
    side = lambda c: marks.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["u_size"].to_numpy().astype(np.int64) + batch["v_size"].to_numpy()
            apart = [differing(a.as_py(), b.as_py()) for a, b in zip(batch["u_bits"], batch["v_bits"])]
            ok = 9 * np.array(apart, np.int64) <= sizes
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(ok))

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u bigint, v bigint")


def candidates(docs: DataFrame, sets: Sets, roots: DataFrame, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """u, v: pairs of texts, by their keys, that may have a Jaccard similarity of four fifths or more.

    ``sets`` makes the sorted distinct hashes of a text; ``roots`` (node, root) are groups known before,
    nodes that are not in it stand alone.  No similar pair of different groups is left out.
    """
    often = stored(frequent(docs, sets))
    heads = prefixes(docs, sets, often).join(small(roots, 16), "node", "left")
    heads = stored(heads.select("node", F.coalesce("root", "node").alias("root"), "size", "bits", "tokens"))
    rows = heads.select("node", "root", "size", F.posexplode("tokens").alias("place", "token"))
    parts = small(_parts(rows, often, crowded, block), 16)
    rows = rows.join(parts, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).filter("parts > 0")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.withColumn("own", own).select("*", other.alias("other"))
    pair = F.when(F.col("parts") == 1, F.col("token")).otherwise(
        F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    )
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.select(pair.alias("group"), "node", "root", "size", "place")
    found = grouped.repartition(count, "group").sortWithinPartitions("group").mapInArrow(_pairs, "u bigint, v bigint")
    return _apart(stored(found.distinct()), heads)
