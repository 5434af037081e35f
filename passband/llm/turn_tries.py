"""Prefix tries of conversations, built as burst tries (operator 12).

A conversation is a path of turn ids; equal paths are one row with a count.  All paths begin in one
container under the root.  A container of more than ``LIMIT`` distinct paths bursts: its paths move on
to containers under the next turn id, and the turn that was its head becomes a node of the upper trie.
Several levels burst in one round, and a prefix that all paths of a container share is skipped, so
that rounds do not follow depth.  Containers that are left are small; each is sorted and swept into
nodes by one task.  The nodes of the upper trie are sums over the containers below.

Texts stay behind: what moves is 24 octets per turn, a digest of role and text with the text's length.
A conversation's path is one value, so a single conversation is held by one task without its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passband.llm.common import small, stored

#: Octets of a turn in a path: digest and length of the text.
DIGEST, TURN = 16, 24
#: Distinct paths that a container may hold.
LIMIT = 1024
#: Levels that burst in one round.
LEVELS = 8
EMPTY = hashlib.sha256(b"").hexdigest()


def _turn() -> Column:
    """A turn as 48 hex digits: digest of role and text, and the text's octets."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("bigint")), 2 * (TURN - DIGEST), "0"))


def rebuilt(turns: DataFrame, family: int = 5, spread: int = 9) -> DataFrame:
    """conv_id, path of every conversation: the first h turns of conversation ``c - c % family``, then
    its own after the first h, where h is the CRC-32 of the decimal c modulo ``spread``.

    Turns are ordered by turn, null first; of equal numbers the order is that of their digests, and
    repeated rows are turns each.  Rows with a null conv_id belong to no conversation.  The remainder
    of a negative number is negative, as in SQL.
    """
    c = F.col("conv_id")
    key = F.struct(F.col("turn").isNotNull().alias("known"), "turn", _turn().alias("id"))
    own = (
        turns.select(c.cast("bigint").alias("conv_id"), "turn", "role", "text")
        .filter("conv_id IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.transform(F.array_sort(F.collect_list(key)), lambda t: t["id"]).alias("turns"))
    )
    first = own.filter(c % family == 0).select(c.alias("base"), F.slice("turns", 1, spread - 1).alias("first"))
    h = (F.crc32(c.cast("string").cast("binary")) % spread).cast("int")
    joined = own.withColumns({"h": h, "base": c - c % family}).join(first, "base", "left")
    none = F.array().cast("array<string>")
    head = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))


def _prefix(depth: Column | str) -> Column:
    return F.substring(F.col("path"), F.lit(1), F.col(depth) * TURN if isinstance(depth, str) else depth * TURN)


def _named(prefix: Column) -> Column:
    return F.unhex(F.md5(prefix))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path_id, path, turns, n, least, ends: every distinct path, its conversations counted, the
    smallest of them, and the digest of all their numbers in ascending order.

    The digest is one stream by its definition: a task reads the sorted numbers of a path one by one
    and holds none of them.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = least = digest = None
        n, out = 0, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["path_id", "n", "least", "ends"])

        for batch in batches:
            for p, c in zip(batch["path_id"].to_pylist(), batch["conv_id"].to_pylist()):
                if p != path:
                    if n:
                        out.append((path, n, least, digest.hexdigest()))
                    path, least, n, digest = p, c, 1, hashlib.sha256(str(c).encode())
                else:
                    digest.update(b",%d" % c)
                    n += 1
            yield emit()
        if n:
            out.append((path, n, least, digest.hexdigest()))
        yield emit()

    spark = convs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = stored(convs.select("conv_id", "path", _named(F.col("path")).alias("path_id")))
    ends = (
        named.select("path_id", "conv_id")
        .repartition(parts, "path_id")
        .sortWithinPartitions("path_id", "conv_id")
        .mapInArrow(digests, "path_id binary, n bigint, least bigint, ends string")
    )
    paths = named.select("path_id", "path").dropDuplicates(["path_id"])
    turns = F.floor(F.length("path") / TURN).cast("int").alias("turns")
    return paths.join(ends, "path_id").select("path_id", "path", turns, "n", "least", "ends")


def burst(paths: DataFrame, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """``paths`` with depth and upper: the container of a path is its prefix of that many turns.

    ``upper`` marks paths that end at a node of the upper trie; they are in no container.
    """
    active = paths.select("path_id", "path", "turns", F.lit(0).alias("at"))
    placed: DataFrame | None = None
    while True:
        # every prefix of the next levels, and whether it holds more than a container may
        depth = F.explode(F.sequence(F.col("at"), F.least(F.col("turns"), F.col("at") + levels - 1)))
        shown = active.select("path_id", "path", "turns", depth.alias("depth"))
        named = shown.select("path_id", "turns", "depth", _named(_prefix("depth")).alias("head"))
        heavy = stored(named.groupBy("head").count().filter(F.col("count") > limit).select("head", F.lit(True).alias("heavy")))
        marked = named.join(small(heavy, 48), "head", "left")
        fits = F.min(F.when(F.col("heavy").isNull(), F.col("depth")))
        done = marked.groupBy("path_id").agg(fits.alias("depth"), F.max("depth").alias("last"), F.max("turns").alias("turns"))
        ended = F.col("depth").isNull() & (F.col("last") == F.col("turns"))
        found = stored(
            done.select(
                "path_id",
                F.when(ended, F.col("turns")).otherwise(F.col("depth")).alias("depth"),
                ended.alias("upper"),
                (F.col("last") + 1).alias("at"),
            )
        )
        now = found.filter("depth IS NOT NULL").select("path_id", "depth", "upper")
        placed = now if placed is None else placed.unionByName(now)
        left = active.select("path_id", "path", "turns").join(found.filter("depth IS NULL").select("path_id", "at"), "path_id")
        left = stored(left.withColumn("head", _named(F.substring(F.col("path"), F.lit(1), (F.col("at") - 1) * TURN))))
        if left.isEmpty():
            return paths.join(stored(placed), "path_id")
        active = skipped(left)


def skipped(left: DataFrame) -> DataFrame:
    """``left`` (path_id, path, turns, at, head) with ``at`` moved to the last depth at which the paths
    of a head are still one: what they share is what the least and the greatest of them share."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = []
            for a, b in zip(batch["low"].to_pylist(), batch["high"].to_pylist()):
                depth.append(common_turns(a, b))
            yield pa.RecordBatch.from_arrays([batch["head"], pa.array(depth, pa.int32())], names=["head", "shared"])

    ends = left.groupBy("head").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    same = stored(ends.mapInArrow(shared, "head binary, shared int"))
    return left.join(small(same, 32), "head").select("path_id", "path", "turns", F.greatest("at", "shared").alias("at"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * TURN] == b[: middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


NODE = (
    "head binary, above binary, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved bigint, ends string, path binary"
)
NAMES = [c.split()[0] for c in NODE.split(", ")]


class Container:
    """The nodes of one container, from its sorted paths; a node is held as a list of its numbers."""

    DEPTH, LEAST, CONVS, CHILDREN, LEAVES, SAVED, ENDS, PARENT, SIZE = range(9)

    def __init__(self, depth: int):
        self.depth, self.nodes, self.open, self.last = depth, [], [], b""

    def add(self, path: bytes, n: int, least: int, ends: str) -> None:
        turns = len(path) // TURN
        keep = common_turns(self.last, path) if self.nodes else self.depth - 1
        self.close(keep)
        for depth in range(max(keep + 1, self.depth), turns + 1):
            parent = self.open[-1] if self.open else None
            if parent is not None:
                self.nodes[parent][self.CHILDREN] += 1
            size = int.from_bytes(path[depth * TURN - TURN + DIGEST : depth * TURN]) if depth else 0
            self.open.append(len(self.nodes))
            self.nodes.append([depth, least, 0, 0, 0, 0, EMPTY, parent, size])
        node = self.nodes[self.open[-1]]
        node[self.CONVS] += n
        node[self.LEAST] = min(node[self.LEAST], least)
        node[self.ENDS] = ends
        self.last = path

    def close(self, depth: int) -> None:
        """Close nodes deeper than ``depth``: their sums are whole, and go into those of their parents."""
        while self.open and self.nodes[self.open[-1]][self.DEPTH] > depth:
            node = self.nodes[self.open.pop()]
            node[self.SAVED] += (node[self.CONVS] - 1) * node[self.SIZE]
            node[self.LEAVES] = node[self.LEAVES] or 1
            if node[self.PARENT] is not None:
                above = self.nodes[node[self.PARENT]]
                for part in (self.CONVS, self.LEAVES, self.SAVED):
                    above[part] += node[part]
                above[self.LEAST] = min(above[self.LEAST], node[self.LEAST])

    def rows(self) -> Iterator[tuple]:
        """:data:`NODE` of all nodes; only the topmost has a head, for it hangs on the upper trie."""
        self.close(-1)
        top = self.last[: self.depth * TURN]
        for depth, least, convs, children, leaves, saved, ends, parent, _ in self.nodes:
            first = parent is None
            yield (
                hashlib.md5(top).digest() if first else None,
                hashlib.md5(top[:-TURN]).digest() if first and depth else None,
                depth, least, None if first else self.nodes[parent][self.LEAST], convs, children, leaves, saved, ends,
                top if first else None,
            )


def swept(placed: DataFrame) -> DataFrame:
    """:data:`NODE` rows of all containers, each swept by one task in the order of its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary())
        held, of = None, None

        def emit(rows) -> Iterator[pa.RecordBatch]:
            rows = list(rows)
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=NAMES)

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("head", "depth", "path", "n", "least", "ends"))
            for head, depth, path, n, least, ends in zip(*columns):
                if head != of:
                    if held is not None:
                        yield from emit(held.rows())
                    held, of = Container(depth), head
                held.add(path, n, least, ends)
        if held is not None:
            yield from emit(held.rows())

    spark = placed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.filter("NOT upper").select(_named(_prefix("depth")).alias("head"), "depth", "path", "n", "least", "ends")
    return rows.repartition(parts, "head").sortWithinPartitions("head", "path").mapInArrow(run, NODE)


def upper_nodes(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """:data:`NODE` rows of the upper trie (parents by head), from the tops of containers
    (:data:`NODE`) and the paths that end in it."""
    below = tops.select("path", F.col("depth").alias("last"), "n_convs", "conv_id", "n_leaves", "saved", F.lit(EMPTY).alias("ends"), (F.col("depth") - 1).alias("to"))
    here = ended.select(
        "path", F.col("turns").alias("last"), F.col("n").alias("n_convs"), F.col("least").alias("conv_id"),
        F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved"), "ends", F.col("turns").alias("to"),
    )
    both = below.unionByName(here).filter("to >= 0")
    shown = both.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("to"))))
    size = F.conv(F.hex(F.substring(F.col("path"), F.col("depth") * TURN - (TURN - DIGEST) + 1, F.lit(TURN - DIGEST))), 16, 10).cast("bigint")
    ends = F.max(F.when(F.col("last") == F.col("to"), F.when(F.col("depth") == F.col("to"), F.col("ends"))))
    heads = stored(
        shown.select(
            "*",
            _named(_prefix("depth")).alias("head"),
            F.when(F.col("depth") > 0, _named(F.substring(F.col("path"), F.lit(1), (F.col("depth") - 1) * TURN))).alias("above"),
            F.when(F.col("depth") > 0, size).otherwise(F.lit(0)).alias("size"),
        )
        .groupBy("head", "above", "depth", "size")
        .agg(
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved").alias("below"), F.coalesce(ends, F.lit(EMPTY)).alias("ends"), F.min(_prefix("depth")).alias("path"),
        )
    )
    children = heads.select("above").unionByName(tops.select("above")).filter("above IS NOT NULL").groupBy(F.col("above").alias("head")).agg(F.count(F.lit(1)).alias("n_children"))
    own = (F.col("n_convs") - 1) * F.col("size")
    inside = (
        heads.select("path", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("depth"))
        .groupBy(_named(_prefix("depth")).alias("head"))
        .agg(F.sum("own").alias("own"))
    )
    return stored(
        heads.join(children, "head").join(inside, "head").select(
            "head", "above", "depth", "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children",
            "n_leaves", (F.col("below") + F.col("own")).alias("saved"), "ends", "path",
        )
    )


def prefix_trie(turns: DataFrame, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every
    node of the trie of rebuilt conversations.

    Without conversations there are no nodes.  Null roles and texts are empty ones; for the order of
    turns, repeated rows and null numbers see :func:`rebuilt`.
    """
    placed = stored(burst(stored(distinct_paths(rebuilt(turns))), limit, levels))
    nodes = stored(swept(placed))
    tops = nodes.filter("head IS NOT NULL")
    upper = upper_nodes(tops, placed.filter("upper"))
    parents = small(stored(upper.select(F.col("head").alias("above"), F.col("conv_id").alias("parent"))), 48)
    hung = upper.unionByName(tops).join(parents, "above", "left").withColumn("parent_conv_id", F.col("parent")).drop("parent")
    return hung.unionByName(nodes.filter("head IS NULL")).select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def sql(family: int = 5, spread: int = 9) -> str:
    """The same nodes by grouping every prefix; CRC-32 is folded from a table made by its rule."""
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k0 AS (SELECT list(i::UBIGINT ORDER BY i) AS t FROM range(256) r(i)),
{", ".join(f"k{b + 1} AS (SELECT list_transform(t, lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END) AS t FROM k{b})" for b in range(8))},
k AS MATERIALIZED (SELECT t FROM k8),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
h AS (SELECT conv_id, conv_id - conv_id % {family} AS base,
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
          lambda a, b: xor(t[(xor(a, b) % 256 + 1)::BIGINT], a // 256)), 4294967295::UBIGINT)::BIGINT % {spread} AS take
      FROM (SELECT DISTINCT conv_id FROM c), k),
b AS (SELECT h.conv_id, n AS place, role, text FROM h JOIN r ON r.conv_id = h.base AND n <= take
      UNION ALL SELECT h.conv_id, 1000000 + n, role, text FROM h JOIN r USING (conv_id) WHERE n > take),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS d, md5(strlen(role) || ':' || role || text) AS id, strlen(text) AS size FROM b),
p AS MATERIALIZED (
  SELECT conv_id, d, size, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM o
  UNION ALL SELECT conv_id, 0, 0, '' FROM h),
z AS (SELECT conv_id, max(d) AS ends FROM p GROUP BY conv_id),
g AS MATERIALIZED (
  SELECT path, d, min(conv_id) AS conv_id, any_value(size) AS size, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = ends), '')) AS ends
  FROM p JOIN z USING (conv_id) GROUP BY path, d),
e AS MATERIALIZED (SELECT a.path, a.d, count(*) FILTER (b.d = a.d + 1) AS kids, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g c WHERE c.d = b.d + 1 AND left(c.path, 32 * b.d) = b.path)) AS leaves,
        sum((b.n - 1) * b.size) AS saved FROM g a JOIN g b ON b.d >= a.d AND left(b.path, 32 * a.d) = a.path GROUP BY a.path, a.d)
SELECT g.conv_id, g.d::BIGINT AS depth, q.conv_id AS parent_conv_id, g.n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN e ON e.path = g.path AND e.d = g.d LEFT JOIN g q ON q.d = g.d - 1 AND q.path = left(g.path, 32 * (g.d - 1))
"""
