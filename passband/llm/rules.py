"""Document rules from words, lines, repeats and compression ratios (operator 9).

Bands: the whole text and each fixed chunk of it are compressed with zstandard.  A ratio above the
upper limit of a length class is repetitive text, one below the lower limit is noise.  Short texts
compress little whatever they hold, so each class has limits of its own.  Encoded binary is text of
ASCII alone and compresses to the bits of its alphabet, which clean text of other scripts nearly does
when short; so texts that are nearly all ASCII have a lower limit of their own, above encoded noise.

The ratio of clean prose grows with its length and varies little.  Where there are labels, the ratios
of trusted texts set much closer limits for whole texts, one pair for every half octave of lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passband.llm.common import WORD, slices, small, stored
from passband.llm.perplexity import trusted_ids

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5
CHUNK, LEVEL = 4096, 3


@dataclass(frozen=True)
class Band:
    """Limits of the ratio of bytes to compressed bytes for texts of at least ``length`` bytes."""

    length: int
    low: float
    high: float


#: Whole documents.  A frame has some dozen bytes of its own, hence the low floor of short texts.
DOCUMENT_BANDS = (Band(0, 0.0, 2.5), Band(256, 1.05, 2.8), Band(1024, 1.2, 3.4), Band(8192, 1.3, 4.0))
#: Chunks of ``CHUNK`` bytes; the last one may be shorter and is judged from 512 bytes on.
CHUNK_BANDS = (Band(0, 0.0, float("inf")), Band(512, 1.05, 3.2), Band(2048, 1.15, 3.8))
#: Lower limits of documents and chunks with at least the share ASCII of their bytes in ASCII: base64 of
#: random bytes reaches 1.25 below 1 KB and 1.33 beyond, Latin-script prose 1.4 and 1.7.
ASCII = 0.9
ASCII_BANDS = (Band(0, 0.0, float("inf")), Band(512, 1.3, float("inf")), Band(1024, 1.4, float("inf")))
#: A document is rejected if more than this share of its judged chunks, or so many in a row, are out of their bands.
CHUNK_SHARE, CHUNK_RUN = 0.2, 2

#: Limits from trusted texts: quantiles of a class and room beyond them, trusted texts that a class
#: needs, bytes from which texts are judged so, and steps of the scale that quantiles are counted on.
QUANTILE, MARGIN, MEMBERS, LEAST, STEPS = 0.999, 0.02, 20, 256, 1000


def band(bands: Sequence[Band], length: int) -> Band:
    return [b for b in bands if b.length <= length][-1]


def inside(bands: Sequence[Band], octets: bytes, ratio: float) -> bool:
    """Whether ``ratio`` is within the limits for ``octets``."""
    limits = band(bands, len(octets))
    beyond = 0 if octets.isascii() else len(octets.translate(None, bytes(range(128))))
    low = limits.low if beyond > (1 - ASCII) * len(octets) else max(limits.low, band(ASCII_BANDS, len(octets)).low)
    return low <= ratio <= limits.high


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a ``window``-word run found twice or more, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    # runs of two words, of four, then of five are numbered exactly, none by a lossy hash
    run, width = ids, 1
    while width < window:
        step = min(width, window - width)
        tail = run if step == width else ids
        m = n - width - step + 1
        pair = run[:m] * np.int64(n + 1) + (tail[width : width + m])
        _, run, counts = np.unique(pair, return_inverse=True, return_counts=True)
        width += step
    again = np.flatnonzero(counts[run] > 1)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + window, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x.encode())]
    return len(lines) - len(set(lines))


def judge(text: str | None) -> tuple:
    """Features and verdict of one text, in the order of :data:`OUT` without doc_id."""
    text = text or ""
    octets = text.encode()
    words = WORD.findall(octets)
    n, repeats = len(words), repeated_words(words)
    solid = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    failed = n < 10 or 100 * repeats > 20 * n
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    ratio = len(octets) / len(compress(octets)) if octets else 0.0
    out = judged = run = longest = 0
    for at in range(0, len(octets), CHUNK):
        part = octets[at : at + CHUNK]
        if band(CHUNK_BANDS, len(part)).high != float("inf"):
            bad = not inside(CHUNK_BANDS, part, len(part) / len(compress(part)))
            judged, out, run = judged + 1, out + bad, run + 1 if bad else 0
            longest = max(longest, run)
    share = out / judged if judged else 0.0
    within = inside(DOCUMENT_BANDS, octets, ratio) and share <= CHUNK_SHARE and longest < CHUNK_RUN
    return n, solid, len(SYMBOLS.findall(text)), duplicate_lines(text), repeats, failed, not failed and within, ratio, share, len(octets)


OUT = (
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("zstd_ratio", pa.float64()),
    ("chunks_out", pa.float64()),
    ("n_bytes", pa.int64()),
)


def features(docs: DataFrame) -> DataFrame:
    """Word features, compression ratios and the verdict of the fixed bands, one row per row.

    A null or empty text has no words and fails the base rules; repeated rows are judged each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000, 4 << 20):
            columns = list(zip(*map(judge, batch["text"].to_pylist()))) or [()] * len(OUT)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, kind) for c, (_, kind) in zip(columns, OUT))],
                names=["doc_id", *(n for n, _ in OUT)],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, zstd_ratio double, chunks_out double, n_bytes bigint",
    )


def length_class() -> Column:
    """Half octaves of the length in bytes."""
    return F.floor(2 * F.log2("n_bytes")).cast("int")


def limits(found: DataFrame, labels: DataFrame) -> DataFrame:
    """class, low, high: limits of ratios from the trusted texts of each length class.

    Quantiles are counted on a scale of bounded length, so no task holds the texts of a class.
    Classes with fewer than ``MEMBERS`` trusted texts have no row.
    """
    good = found.filter(~F.col("base_failed") & (F.col("n_bytes") >= LEAST)).join(trusted_ids(labels), "doc_id", "left_semi")
    step = F.floor(F.col("zstd_ratio") * STEPS).cast("bigint")
    bins = good.groupBy(length_class().alias("class"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("class")
    seen = F.sum("n").over(of.orderBy("step"))
    counted = bins.select("class", "step", seen.alias("seen"), F.sum("n").over(of).alias("all"))
    low = F.min(F.when(F.col("seen") > (1 - QUANTILE) * F.col("all"), F.col("step")))
    high = F.min(F.when(F.col("seen") >= QUANTILE * F.col("all"), F.col("step")))
    return (
        counted.groupBy("class")
        .agg(low.alias("low"), high.alias("high"), F.max("all").alias("all"))
        .filter(F.col("all") >= MEMBERS)
        .select("class", (F.col("low") / STEPS * (1 - MARGIN)).alias("low"), ((F.col("high") + 1) / STEPS * (1 + MARGIN)).alias("high"))
    )


def judged(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """:func:`features` with the limits that trusted texts set, where there are labels.

    A document is kept if it passes the base rules, the fixed bands and the limits of its length
    class.  Texts below ``LEAST`` bytes and classes without limits are left to the fixed bands.
    """
    if labels is None:
        return features(docs)
    found = stored(features(docs))
    known = small(stored(limits(found, labels)), 32)
    cls = F.when(F.col("n_bytes") >= LEAST, length_class()).alias("class")
    near = found.withColumn("class", cls).join(known, "class", "left")
    within = F.coalesce(F.col("zstd_ratio").between(F.col("low"), F.col("high")), F.lit(True))
    return near.select(*(F.col(c) if c != "kept" else (F.col("kept") & within).alias("kept") for c in found.columns))
