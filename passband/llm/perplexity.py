"""Quality by perplexity under an interpolated modified Kneser-Ney model (operator 7).

The model is one of character trigrams, trained on the texts that the labels trust.  Nothing of it
is held by a single machine: counts, contexts and probabilities are tables sharded by n-gram.

1. Documents are read once, in blocks.  A block leaves one row per distinct trigram in it, with the
   documents that hold it and how often: an inverted index whose rows grow with blocks, not texts.
2. Counts of the trusted documents are summed per trigram, and the lower orders, discounts and
   contexts are derived from them by joins on the shards.
3. Every trigram seen anywhere gets its probability from the tables once, by the same joins.
4. The index is joined to the probabilities, each task adds up what its shard knows of the documents
   of a block, and the sums of a block's shards make the perplexities of its documents.

A document is rejected if its perplexity is above the limit of its language, which is set by
quantiles of the trusted documents in that language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm.common import slices, small, stored, text_key

#: Documents and bytes of a block, and the greatest count of one posting.
ROWS, OCTETS = 1024, 4 << 20
ROW_BITS = 10
MOST = 255
#: Symbols whose trigrams are made at once.
PART = 1 << 19
#: Symbols beyond Unicode that stand before and after a text.
BEGIN, END = 0x110000, 0x110001
#: Octets of document sums a task holds before it passes them on.
HELD = 16 << 20
#: Steps of the perplexity scale per octave: quantiles are exact to a 500th of an octave.
STEPS = 500
#: A language's limit lies above its median by this multiple of the distance to the quantile.
QUANTILE, REACH = 0.99, 2.5
#: A short text's mean is drawn to its language's median as if it had so many symbols more.
PRIOR = 120

INDEX = "gram bigint, block bigint, postings binary, doc_ids array<bigint>, keys array<bigint>, langs array<string>, sizes array<bigint>"


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """row and symbol in parts of about ``PART`` symbols; each text has two beginnings and an end.

    A long text comes in several parts; each begins with the last two symbols of the one before, so
    every run of three symbols lies in one part.
    """
    begin, end = (np.array([s], "<u4") for s in (BEGIN, END))
    rows: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for row, text in enumerate(texts):
        points = np.concatenate([begin, begin, np.frombuffer(text.encode("utf-32-le"), "<u4"), end])
        if len(points) <= PART:
            rows.append(row)
            held.append(points)
            size += len(points)
            if size > PART:
                yield np.repeat(rows, [len(h) for h in held]), np.concatenate(held)
                rows, held, size = [], [], 0
            continue
        for at in range(0, len(points) - 2, PART):
            more = points[at : at + PART + 2]
            yield np.full(len(more), row), more
    if held:
        yield np.repeat(rows, [len(h) for h in held]), np.concatenate(held)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (trigram, row) pairs with counts, ordered by trigram, and symbols per row."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row, points in _parts(texts):
        # the few symbols of a part are numbered, so that a pair fits one machine word
        present = np.zeros(END + 1, np.int32)
        present[points] = 1
        symbols = np.flatnonzero(present)
        present[symbols] = np.arange(len(symbols))
        small_ids, base = present[points].astype(np.int64), len(symbols)
        code = (small_ids[:-2] * base + small_ids[1:-1]) * base + small_ids[2:]
        inside = row[:-2] == row[2:]
        cells, n = np.unique(code[inside] << ROW_BITS | row[2:][inside], return_counts=True)
        code = cells >> ROW_BITS
        first, second, third = symbols[code // (base * base)], symbols[code // base % base], symbols[code % base]
        gram = first << 42 | second << 21 | third
        found.append((gram, (cells & ((1 << ROW_BITS) - 1)).astype(np.int16), n.astype(np.int32)))
    gram, row, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, gram))
    gram, row, n = gram[order], row[order], n[order]
    new = np.append(True, (np.diff(gram) != 0) | (np.diff(row) != 0))
    starts = np.flatnonzero(new)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return gram[starts], row[starts].astype(np.int64), np.add.reduceat(n.astype(np.int64), starts), sizes


def _planes(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First octet of every posting, and how far its next ones lie, for rows of ``sizes`` postings."""
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + inside, np.repeat(sizes, sizes)


def _packed(row: np.ndarray, n: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Postings per trigram: all counts, then low, then high octets of steps between documents.

    Most counts are one, most steps are short and high octets are zero, so the planes compress well.
    """
    step = np.diff(row, prepend=0)
    step[starts] = row[starts]
    sizes = np.diff(np.append(starts, len(row)))
    at, wide = _planes(3 * starts, sizes)
    out = np.empty(3 * len(row), np.uint8)
    out[at], out[at + wide], out[at + 2 * wide] = n, step & 255, step >> 8
    ends = (3 * np.append(starts, len(row))).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row of the batch, document and count of all postings."""
    column = batch["postings"]
    ends = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends) // 3
    at, wide = _planes(starts, sizes)
    total = np.cumsum(flat[at + wide].astype(np.int64) | flat[at + 2 * wide].astype(np.int64) << 8)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    row = np.repeat(np.arange(len(column)), sizes)
    return row, total - before[row], flat[at].astype(np.int64)


def indexed(docs: DataFrame) -> DataFrame:
    """The inverted index of :data:`INDEX`: postings per (trigram, block), and one head row per block.

    The head has a null trigram and the block's documents.  A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in slices(batches, "text", ROWS, OCTETS):
            texts = [t or "" for t in batch["text"].to_pylist()]
            gram, row, n, sizes = trigrams(texts)
            # a count beyond one octet takes several postings
            times = -(-n // MOST)
            gram, row, n = np.repeat(gram, times), np.repeat(row, times), np.repeat(n, times)
            place = np.arange(len(n)) - np.repeat(np.cumsum(times) - times, times)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1])
            binary = _packed(row, np.minimum(n - place * MOST, MOST), starts)
            block = batch["_row"][0].as_py()
            head = {
                "gram": pa.array([None], pa.int64()),
                "postings": pa.array([None], pa.binary()),
                "doc_ids": pa.array([batch["doc_id"].to_pylist()], pa.list_(pa.int64())),
                "keys": pa.array([batch["text_key"].to_pylist()], pa.list_(pa.int64())),
                "langs": pa.array([batch["lang"].to_pylist()], pa.list_(pa.string())),
                "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
            }
            none = len(starts)
            body = {
                "gram": pa.array(gram[starts]),
                "postings": binary,
                **{c: pa.nulls(none, head[c].type) for c in ("doc_ids", "keys", "langs", "sizes")},
            }
            for part_ in (head, body):
                rows = len(part_["gram"])
                part_["block"] = pa.array([block] * rows, pa.int64())
                names = ["gram", "block", "postings", "doc_ids", "keys", "langs", "sizes"]
                schema = schema or pa.schema([(c, part_[c].type) for c in names])
                yield pa.RecordBatch.from_arrays([part_[c] for c in names], schema=schema)

    return docs.select(
        F.col("doc_id").cast("bigint"),
        text_key(F.col("text")).alias("text_key"),
        F.col("lang").cast("string"),
        F.col("text").cast("string"),
        F.monotonically_increasing_id().alias("_row"),
    ).mapInArrow(run, INDEX)


def documents_of(index: DataFrame) -> DataFrame:
    """block, place, doc_id, text_key, lang, size of every document of the index."""
    heads = index.filter("gram IS NULL").select("block", "doc_ids", "keys", "langs", "sizes")
    return heads.select("block", F.posexplode(F.arrays_zip("doc_ids", "keys", "langs", "sizes"))).select(
        "block",
        F.col("pos").alias("place"),
        F.col("col.doc_ids").alias("doc_id"),
        F.col("col.keys").alias("text_key"),
        F.col("col.langs").alias("lang"),
        F.col("col.sizes").alias("size"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that the labels call good and not toxic; contradicting labels are no trust."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
        .filter("good")
        .select("doc_id")
    )


def trusted_counts(index: DataFrame, documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """gram, n: counts over the trusted documents."""
    places = documents.join(trusted, "doc_id", "left_semi").groupBy("block").agg(
        F.collect_set("place").alias("places")  # at most ROWS
    )
    rows = index.filter("gram IS NOT NULL").select("gram", "block", "postings")
    marked = rows.join(small(stored(places), 4 * ROWS), "block").select("gram", "postings", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, doc, n = _unpacked(batch)
            mask = np.zeros((batch.num_rows, ROWS), bool)
            lists = batch["places"]
            mask[np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()] = True
            sums = np.bincount(row, np.where(mask[row, doc], n, 0), minlength=batch.num_rows).astype(np.int64)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [batch["gram"].take(pa.array(some)), pa.array(sums[some])], names=["gram", "n"]
            )

    return marked.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from counts of counts."""
    sizes = dict(counts.filter("n <= 4").groupBy("n").count().collect())
    n1, n2, n3, n4 = (sizes.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5  # too few rare n-grams to estimate them
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))


def _level(counts: DataFrame, context: str, discounts: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Per n-gram its discounted share, and per context the weight left to the lower order."""
    d1, d2, d3 = discounts
    n = F.col("n")
    cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
    contexts = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(cut).alias("left"))
    shares = counts.join(contexts, context).select("gram", ((n - cut) / F.col("total")).alias("share"))
    return shares, contexts.select(F.col(context), (F.col("left") / F.col("total")).alias("weight"))


LOW = (1 << 21) - 1


def probabilities(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, nll: minus log2 of the probability of every trigram of ``grams``, by joins on shards."""
    tri = stored(counts.withColumn("context", F.shiftright("gram", 21)))
    bi = stored(
        tri.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 42) - 1)).alias("gram"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("context", F.shiftright("gram", 21))
    )
    uni = stored(
        bi.groupBy(F.col("gram").bitwiseAND(F.lit(LOW)).alias("gram"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("context", F.lit(0))
    )
    share3, weight3 = _level(tri, "context", _discounts(tri))
    share2, weight2 = _level(bi, "context", _discounts(bi))
    share1, weight1 = _level(uni, "context", _discounts(uni))
    rest = weight1.agg(F.max("weight")).first()[0]
    rest = 1.0 if rest is None else rest
    symbols = uni.count() + 1  # one more for all that were never seen

    def named(df: DataFrame, key: str, value: str) -> DataFrame:
        return df.select(F.col(df.columns[0]).alias(key), F.col(df.columns[1]).alias(value))

    zero, one = F.lit(0.0), F.lit(1.0)
    p1 = F.coalesce("s1", zero) + rest / symbols
    p2 = F.coalesce("s2", zero) + F.coalesce("w2", one) * p1
    p3 = F.coalesce("s3", zero) + F.coalesce("w3", one) * p2
    return (
        grams.select(
            "gram",
            F.shiftright("gram", 21).alias("uv"),
            F.col("gram").bitwiseAND(F.lit((1 << 42) - 1)).alias("vw"),
            F.shiftright("gram", 21).bitwiseAND(F.lit(LOW)).alias("v"),
            F.col("gram").bitwiseAND(F.lit(LOW)).alias("w"),
        )
        .join(named(share3, "gram", "s3"), "gram", "left")
        .join(named(weight3, "uv", "w3"), "uv", "left")
        .join(named(share2, "vw", "s2"), "vw", "left")
        .join(named(weight2, "v", "w2"), "v", "left")
        .join(named(share1, "w", "s1"), "w", "left")
        .select("gram", (-F.log2(p3)).alias("nll"))
    )


def summed(index: DataFrame, scores: DataFrame) -> DataFrame:
    """block, sums: sums of nll per document of each block, as raw doubles, from one task each."""
    rows = index.filter("gram IS NOT NULL").select("gram", "block", "postings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([s.tobytes() for s in held.values()], pa.binary())],
                names=["block", "sums"],
            )
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            row, doc, n = _unpacked(batch)
            blocks, at = np.unique(batch["block"].to_numpy(), return_inverse=True)
            worth = batch["nll"].to_numpy()[row] * n
            sums = np.bincount(at[row] * ROWS + doc, worth, minlength=len(blocks) * ROWS).reshape(-1, ROWS)
            for b, s in zip(blocks.tolist(), sums):
                if b in held:
                    held[b] += s
                else:
                    held[b] = s.copy()
            if len(held) * ROWS * 8 > HELD:
                yield emit()
        yield emit()

    return (
        rows.join(scores, "gram")
        .select("block", "postings", "nll")
        .mapInArrow(run, "block bigint, sums binary")
    )


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, size (symbols), perplexity, trusted of every row of ``docs``.

    An empty or null text has the perplexity of the end mark.  Without trusted documents every
    symbol is as likely as any other.
    """
    index = stored(indexed(docs))
    trusted = stored(trusted_ids(labels))
    documents = documents_of(index)
    counts = trusted_counts(index, documents, trusted)
    grams = index.filter("gram IS NOT NULL").select("gram").distinct()
    sums = summed(index, stored(probabilities(counts, grams)))
    heads = index.filter("gram IS NULL").select("block", "doc_ids", "keys", "langs", "sizes")
    parts = sums.withColumns(
        {c: F.lit(None).cast(t) for c, t in heads.dtypes if c != "block"}
    ).unionByName(heads.withColumn("sums", F.lit(None).cast("binary")))

    def close(key: tuple, rows: pa.Table) -> pa.Table:
        total, head = np.zeros(ROWS), None
        for r in rows.to_pylist():
            if r["sums"] is None:
                head = r
            else:
                total += np.frombuffer(r["sums"], "<f8")
        size = np.array(head["sizes"], float)
        return pa.table(
            {
                "doc_id": pa.array(head["doc_ids"], pa.int64()),
                "text_key": pa.array(head["keys"], pa.int64()),
                "lang": pa.array(head["langs"], pa.string()),
                "size": pa.array(head["sizes"], pa.int64()),
                "bits": pa.array(total[: len(size)] / size),
            }
        )

    found = parts.groupBy("block").applyInArrow(
        close, "doc_id bigint, text_key bigint, lang string, size bigint, bits double"
    )
    known = small(trusted, 16).select("doc_id", F.lit(True).alias("trusted"))
    return stored(
        found.join(known, "doc_id", "left").select(
            "doc_id",
            "text_key",
            "lang",
            "size",
            F.pow(2.0, "bits").alias("perplexity"),
            F.coalesce("trusted", F.lit(False)).alias("trusted"),
        )
    )


def limits(found: DataFrame) -> DataFrame:
    """lang, median, limit: steps of the log scale, from the trusted documents of each language.

    The scale has a bounded number of steps, so quantiles are exact counts and not sketches.  A
    language without trusted documents, and documents without one, take those of all together.
    """
    step = F.floor(F.log2("perplexity") * STEPS).cast("bigint")
    bins = found.filter("trusted").groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    bins = stored(bins)
    both = bins.filter("lang IS NOT NULL").unionByName(
        bins.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "step", "n")
    )
    listed = both.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("step", "n"))).alias("bins"), F.sum("n").alias("all")
    )

    def quantile(q: float):
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at"))
        return F.aggregate(
            "bins",
            start,
            lambda a, b: F.struct(
                (a["seen"] + b["n"]).alias("seen"),
                F.when(a["at"].isNull() & (a["seen"] + b["n"] >= q * F.col("all")), b["step"])
                .otherwise(a["at"])
                .alias("at"),
            ),
        )["at"]

    middle, high = quantile(0.5), quantile(QUANTILE)
    return listed.select(
        "lang", (middle / STEPS).alias("median"), ((middle + REACH * (high - middle) + 1) / STEPS).alias("limit")
    )


def judged(found: DataFrame) -> DataFrame:
    """``found`` (as of :func:`scored`) with the language's limit and whether a document is kept.

    Without any trusted document all are kept.
    """
    by_lang = stored(limits(found))
    own = small(by_lang.filter("lang IS NOT NULL"), 64)
    every = by_lang.filter("lang IS NULL").select(
        F.col("median").alias("m_all"), F.col("limit").alias("l_all")
    ).first()
    m_all, l_all = (every.m_all, every.l_all) if every else (None, None)
    median = F.coalesce("median", F.lit(m_all).cast("double"))
    limit = F.coalesce("limit", F.lit(l_all).cast("double"))
    drawn = (F.log2("perplexity") * F.col("size") + median * PRIOR) / (F.col("size") + PRIOR)
    return found.join(own, "lang", "left").select(
        "doc_id",
        "text_key",
        "lang",
        "size",
        "perplexity",
        F.pow(2.0, limit).alias("limit"),
        F.coalesce(drawn <= limit, F.lit(True)).alias("kept"),
    )
