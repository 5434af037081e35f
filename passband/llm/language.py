"""Language of a text by the nearest of several centroids per language (operator 2).

Texts become vectors of hashed character n-grams of their lower-cased letter runs, weighted by
inverse document frequency and normalised.  Each language of the learning rows is clustered by
spherical k-means.  A text gets the language of the centroid with the greatest cosine, and is
rejected if it strays farther from it, for its length, than nearly all learning texts there did.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passband.llm.common import slices, small, stored

#: Hashed n-grams; lengths of n-grams, the white space around a letter run included.
FEATURES, ORDERS = 1 << 14, (1, 2, 3)
#: Learning rows taken per language, about: a row is taken by a hash of its doc_id.
SAMPLE = 1_500
CLUSTERS, STEPS = 4, 12
#: A text may stray from its centroid by this multiple of the quantile of the learning texts there,
#: and by LEAST anyway.  Centroids of fewer than MEMBERS texts have the quantile of their language.
QUANTILE, SLACK, LEAST, MEMBERS = 0.99, 1.5, 0.25, 50
#: n-grams at which the chance of a short text adds as much to its stray as a long text has.
SHORT = 2_400
#: Rows and characters of a dense block.
ROWS, OCTETS = 128, 1 << 20
#: Characters whose n-grams are made at once.
PART = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _symbols(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, letter (0: a gap) and whether it is new, in parts of about ``PART`` characters.

    Runs of other characters are one gap, and every text is closed by one, so that no n-gram spans two
    texts.  A long text comes in several parts; each begins with the last two symbols of the one before.
    """

    def letter(points: np.ndarray) -> np.ndarray:
        low = letters()[np.minimum(points, 0x10FFFF)]
        low[points == 0] = 0
        return low

    def part(rows: list[int], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.concatenate([x for h in held for x in (h, np.zeros(1, "<u4"))])
        row = np.repeat(rows, [len(h) + 1 for h in held])
        low = letter(points)
        keep = low > 0
        keep[1:] |= low[:-1] > 0
        return row[keep], low[keep], np.ones(int(keep.sum()), bool)

    rows: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for row, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
        if len(points) <= PART:
            rows.append(row)
            held.append(points)
            size += len(points)
            if size > PART:
                yield part(rows, held)
                rows, held, size = [], [], 0
            continue
        tail, solid = np.empty(0, np.uint32), False
        for at in range(0, len(points), PART):
            more = points[at : at + PART]
            low = letter(more if at + PART < len(points) else np.append(more, 0))
            keep = low > 0
            keep[1:] |= low[:-1] > 0
            keep[0] |= solid
            solid = bool(low[-1] > 0)
            joined = np.concatenate([tail, low[keep]])
            fresh = np.arange(len(joined)) >= len(tail)
            yield np.full(len(joined), row), joined, fresh
            tail = joined[-(max(ORDERS) - 1) :]
    if held:
        yield part(rows, held)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, feature and count of the n-grams of ``texts``, and which texts have a letter."""
    lettered = np.zeros(len(texts), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for row, low, fresh in _symbols(texts):
        lettered[row[low > 0]] = True
        code = np.full(len(low), 0x9E3779B97F4A7C15, np.uint64)
        part = []
        for n in range(1, max(ORDERS) + 1):
            tail = low[n - 1 :].astype(np.uint64)
            code = (code[: len(tail)] ^ tail) * np.uint64(0xFF51AFD7ED558CCD)
            code ^= code >> np.uint64(29)
            if n in ORDERS:
                inside = (row[: len(tail)] == row[n - 1 :]) & fresh[n - 1 :]
                if n > 1:  # a gap may begin or end an n-gram, not lie within
                    for k in range(1, n - 1):
                        inside &= low[k : k + len(tail)] > 0
                else:
                    inside &= low > 0
                feature = (code[inside] * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - 14)
                part.append(row[: len(tail)][inside] * FEATURES + feature.astype(np.int64))
        found.append(np.unique(np.concatenate(part), return_counts=True))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, lettered
    cells, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    n = np.bincount(place, np.concatenate([n for _, n in found]), len(cells)).astype(np.int64)
    return cells // FEATURES, cells % FEATURES, n, lettered


def vectors(row: np.ndarray, feature: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Dense, normalised rows of (1 + log n) * idf."""
    dense = np.zeros((rows, FEATURES), np.float32)
    dense[row, feature] = (1 + np.log(n)) * idf[feature]
    norm = np.sqrt(np.einsum("ij,ij->i", dense, dense))
    return dense / np.where(norm > 0, norm, 1)[:, None]


@dataclass(frozen=True)
class Model:
    """Centroids of all languages; its size hangs on the number of languages alone."""

    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray


def stray(cosine: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Squared tangent of the angle to a centroid, as a multiple of what ``grams`` n-grams bring by chance.

    A sample's part across its mean falls as one over its length, to what its topic and words keep.
    """
    return (1 / np.maximum(cosine, 1e-6) ** 2 - 1) / (1 + SHORT / np.maximum(grams, 1))


def clustered(points: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and the high quantile of :func:`stray` of the rows at each.

    It starts from rows spread evenly over the order of likeness to the mean, which puts short and
    long texts, or plain and odd ones, into clusters of their own without chasing outliers.
    """
    order = np.argsort(points @ points.mean(axis=0), kind="stable")
    k = min(CLUSTERS, len(points))
    centroids = points[order[((np.arange(k) + 0.5) / k * len(points)).astype(int)]]
    for _ in range(STEPS):
        own = (points @ centroids.T).argmax(axis=1)
        sums = np.stack([points[own == k].sum(axis=0) for k in range(len(centroids))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    cosine = points @ centroids.T
    own, far = cosine.argmax(axis=1), stray(cosine.max(axis=1).astype(float), grams)
    parts = [far[own == k] for k in range(len(centroids))]
    return centroids, np.array([np.quantile(p if len(p) >= MEMBERS else far, QUANTILE) for p in parts])


def learning(docs: DataFrame) -> Column:
    """Rows the query learns from: crc32 of the doc_id's digits, mod 4, is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``rows`` (doc_id, text, lang), of which about ``sample`` are read per language.

    Rows with a null lang or without letters teach nothing.  Features and clusters are made by
    executors; the driver gets document frequencies of the fixed feature set and the centroids.
    """
    rows = rows.filter("lang IS NOT NULL").select(
        F.col("lang"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw")
    )
    sizes = rows.groupBy("lang").count()
    share = small(stored(sizes.select("lang", (F.lit(float(sample << 30)) / F.col("count")).alias("cut"))), 64)
    drawn = rows.join(share, "lang").filter("draw < cut").select("lang", "draw", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ROWS, OCTETS):
            row, feature, n, _ = counts(batch["text"].to_pylist())
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype("i4")
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype("i4"))) for x in (feature, n)]
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], batch["draw"], *lists], names=["lang", "draw", "feature", "n"]
            )

    bags = stored(
        drawn.mapInArrow(features, "lang string, draw bigint, feature array<int>, n array<int>").filter(
            F.size("feature") > 0
        )
    )
    frequency = dict(bags.select(F.explode("feature").alias("f")).groupBy("f").count().collect())
    total = bags.count()
    idf = np.zeros(FEATURES, np.float32)
    for f, n in frequency.items():
        idf[f] = np.log((1 + total) / (1 + n)) + 1

    def cluster(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("draw")
        n = [len(x) for x in table["feature"]]
        flat = [table[c].combine_chunks().flatten().to_numpy() for c in ("feature", "n")]
        points = vectors(np.repeat(np.arange(len(n)), n), *flat, idf, len(n))
        centroids, radius = clustered(points, np.array([sum(x) for x in table["n"].to_pylist()]))
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(radius)),
                "centroid": pa.array([c.tobytes() for c in centroids.astype("<f4")]),
                "radius": pa.array(radius.astype(float)),
            }
        )

    made = bags.groupBy("lang").applyInArrow(cluster, "lang string, centroid binary, radius double").collect()
    made.sort(key=lambda r: r.lang)
    languages = sorted({r.lang for r in made})
    return Model(
        languages,
        np.array([languages.index(r.lang) for r in made], np.int64),
        np.array([np.frombuffer(r.centroid, "<f4") for r in made]).reshape(-1, FEATURES),
        np.array([r.radius for r in made]),
        idf,
    )


def predictions(texts: list[str | None], model: Model) -> list[tuple[str, float, bool]]:
    """Language, cosine to the nearest centroid and whether the text is accepted."""
    row, feature, n, lettered = counts(texts)
    if not len(model.owner):
        return [(UNKNOWN, 0.0, False)] * len(texts)
    cosine = vectors(row, feature, n, model.idf, len(texts)) @ model.centroids.T
    best = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0.0, 1.0)
    grams = np.bincount(row, weights=n, minlength=len(texts))
    near = (score > 1e-6) & (stray(score, grams) <= np.maximum(model.radius[best] * SLACK, LEAST))
    return [
        (model.languages[model.owner[b]], s, bool(ok)) if has else (UNKNOWN, 0.0, False)
        for b, s, ok, has in zip(best.tolist(), score.tolist(), near.tolist(), lettered.tolist())
    ]


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and accepted; only ``text`` is read.

    A null text or one without letters is ``und``, with score 0, and not accepted; so is every text
    if there was nothing to learn from.  Columns that have these names already are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, "lang_pred", "score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ROWS, OCTETS):
            lang, score, ok = zip(*predictions(batch["text"].to_pylist(), shipped.value))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                names=names,
            )

    added = T.StructType.fromDDL("lang_pred string, score double, accepted boolean")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ROWS, OCTETS):
            ok = [x[2] for x in predictions(batch["text"].to_pylist(), shipped.value)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
