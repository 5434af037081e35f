"""Packing token sequences of documents into fixed-size training sequences (operator 10).

Documents are cut only where they are longer than a sequence.  Their pieces are dealt into groups of
bounded size, and each group is packed by itself: best fit by falling length, then local search over
the bins that are not full.  A step of the search moves a document into a fuller bin, exchanges one
for a longer one, or exchanges two for one or one for two; every step raises the sum of squared
fills, which ends with emptied bins.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm.common import slices, stored
from passband.llm.merge_automaton import byte_letters

#: Pieces a group holds on average; a group leaves at most about one sequence partly filled.
GROUP_PIECES = 16_384
#: Rounds of local search over the bins of a group.
ROUNDS = 4
#: Chunks of text kept per worker with their ids.
CACHED_CHUNKS = 200_000


class WordTokens(dict):
    """Chunk between white space -> its ids as bytes, by the given tokenizer file (JSON text).

    The file's pre-tokenizer never lets a token span white space, so a text's ids are those of its
    chunks in turn.  Texts with characters beyond U+017F, special tokens' brackets or separators on
    which Python and the tokenizer differ are left whole to the tokenizer.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer

        parts = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        split = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [n["type"] for n in parts["normalizer"]["normalizers"]]
        plain = kinds == ["NFC", "Replace", "Lowercase"] and not any(
            parts[k] for k in ("truncation", "padding")
        )
        letters = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\u017f"
        numbers = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
        near = split.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        near = near.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]")
        self.split = None if r"\p" in near or not plain else re.compile(near).findall
        marks = {t["content"][0] for t in parts["added_tokens"] if t["content"]}
        self.odd = re.compile(f"[^\\x00-\\u017f]|[\\u0130\\x1c-\\x1f{re.escape(''.join(marks))}]").search
        #: The odd characters of ASCII texts, searched for one by one: much faster than by a pattern.
        self.odd_ascii = [c for c in map(chr, range(128)) if self.odd(c)]
        self.letters = {b: c for c, b in byte_letters().items()}
        #: Ids of pieces: words recur behind other marks, where their chunks are new.
        self.known: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            found = self._made(piece)
            if len(self.known) < CACHED_CHUNKS:
                self.known[piece] = found
        return found

    def _made(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isalnum()):
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def __missing__(self, chunk: str) -> bytes:
        ids = [i for piece in self.split(chunk) for i in self._piece(piece)]
        found = np.array(ids, "<u4").tobytes()
        if len(self) < CACHED_CHUNKS:
            self[chunk] = found
        return found

    def is_odd(self, text: str) -> bool:
        if text.isascii():
            return any(c in text for c in self.odd_ascii)
        return self.odd(text) is not None

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, four little-endian bytes each."""
        if self.split is None or self.is_odd(text):
            whole = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(whole, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def word_tokens(vocabulary: str) -> WordTokens:
    return WordTokens(vocabulary)


def pieces(docs: DataFrame, vocabulary: str | Path, size: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its whole text (null: none) followed by ``end``.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_tokens(shipped.value)
        for batch in slices(batches, "text", 2_000, 4 << 20):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = table.ids(text or "") + last
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers, by falling length into the fullest bin that has room."""
    room: dict[int, list[int]] = defaultdict(list)
    bins: list[list[int]] = []
    open_rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fitting = open_rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(bins), size
            bins.append([])
        bins[b].append(item)
        if r > n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins


class _Search:
    """Local search over bins; ``items[b]`` maps item -> length."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, size: int):
        self.size = size
        self.items = [{i: int(lengths[i]) for i in b} for b in bins]
        self.fill = [sum(x.values()) for x in self.items]
        self.where: dict[int, set[tuple[int, int]]] = defaultdict(set)  # length -> (bin, item)
        self.held = 0  # bit n: some bin holds an item of length n
        for b in range(len(bins)):
            self._show(b)

    def _show(self, b: int) -> None:
        for i, n in self.items[b].items():
            self.where[n].add((b, i))
            self.held |= 1 << n

    def _hide(self, b: int) -> None:
        for i, n in self.items[b].items():
            self.where[n].discard((b, i))
            if not self.where[n]:
                self.held &= ~(1 << n)

    def _find(self, least: int, most: int, fill: int, out: int) -> tuple[int, int, int] | None:
        """The longest item of least..most in a bin emptier than ``fill`` plus what it brings."""
        held = self.held & ((1 << (most + 1)) - 1)
        while held:
            n = held.bit_length() - 1
            if n < least:
                return None
            for b, i in self.where[n]:
                if self.fill[b] < fill + n - out:
                    return n, b, i
            held ^= 1 << n
        return None

    def _swap(self, r: int, give: tuple[int, ...], d: int, take: tuple[int, ...]) -> None:
        self._hide(d)
        mine, theirs = self.items[r], self.items[d]
        for i in give:
            theirs[i] = mine.pop(i)
        for i in take:
            mine[i] = theirs.pop(i)
        moved = sum(mine[i] for i in take) - sum(theirs[i] for i in give)
        self.fill[r] += moved
        self.fill[d] -= moved
        self._show(d)

    def _best(self, r: int):
        """The step that fills bin ``r`` most: (gain, given, donor, taken)."""
        gap, fill = self.size - self.fill[r], self.fill[r]
        best = None
        if found := self._find(1, gap, fill, 0):  # move
            best = (found[0], (), found[1], (found[2],))
        own = list({n: i for i, n in self.items[r].items()}.items())
        singles = [(n, (i,)) for n, i in own]
        pairs = [
            (m + n, (i, j)) for x, (m, i) in enumerate(own) for n, j in own[x + 1 :]
        ]
        for n, give in [*singles, *pairs]:  # one or two for one
            if best and best[0] == gap:
                return best
            least = n + 1 + (best[0] if best else 0)
            if found := self._find(least, min(n + gap, self.size), fill, n):
                best = (found[0] - n, give, found[1], (found[2],))
        for n, give in singles:  # one for two of one bin: the longer is sought among what is held
            for m, i in own:
                if best and best[0] == gap:
                    return best
                goal = n + gap
                found = self._find(max(1, goal // 2), goal - 1, fill, n)
                if not found:
                    break
                first, d, a = found
                second = max(
                    ((k, j) for j, k in self.items[d].items() if j != a and k <= goal - first),
                    default=None,
                )
                if second:
                    gain = first + second[0] - n
                    if gain > (best[0] if best else 0) and self.fill[d] < fill + gain:
                        best = (gain, give, d, (a, second[1]))
                break
        return best

    def round(self) -> bool:
        changed = False
        for r in sorted(range(len(self.items)), key=lambda b: -self.fill[b]):
            if not self.items[r] or self.fill[r] == self.size:
                continue
            self._hide(r)
            while self.fill[r] < self.size and (step := self._best(r)):
                self._swap(r, *step[1:])
                changed = True
            if self.fill[r] < self.size:
                self._show(r)  # full bins stay out of the search
        return changed


def packed(lengths: np.ndarray, size: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Bins of item numbers for items of 1 to ``size`` tokens."""
    bins = best_fit(lengths, size)
    fewest = -(-int(lengths.sum()) // size)
    if len(bins) > fewest:
        fills = [int(lengths[b].sum()) for b in bins]
        full = [b for b, f in zip(bins, fills) if f == size]
        search = _Search([b for b, f in zip(bins, fills) if f < size], lengths, size)
        for _ in range(rounds):
            if not search.round():
                break
            if len(full) + sum(map(bool, search.items)) == fewest:
                break
        bins = full + [list(x) for x in search.items if x]
    return bins


OUT = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint"
)


def sequences(cut: DataFrame, size: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut`` (as of :func:`pieces`) with a sequence and a place in it for every piece.

    Nulls in doc_id, repeated rows and ties are packed like any other piece.  The pieces are written
    once, counted, and dealt evenly by their row, so a group's size does not hang on any key.
    """
    held = stored(cut)
    groups = max(1, -(-held.count() // group_pieces))
    dealt = held.withColumn(
        "_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    )

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        number = np.empty(len(lengths), np.int64)
        offset = np.empty(len(lengths), np.int64)
        for b, items in enumerate(packed(lengths, size)):
            number[items] = b
            ends = np.cumsum(lengths[items])
            offset[items] = ends - lengths[items]
        number += key[0].as_py() << 32
        return rows.drop_columns("_group").append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offset)
        )

    return dealt.groupBy("_group").applyInArrow(pack, OUT)
