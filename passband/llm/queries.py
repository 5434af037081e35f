"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.llm import (
    language,
    licences,
    neighbours,
    packing,
    perplexity,
    pivots,
    quantised,
    revisits,
    rules,
    simhash,
    tokens,
    turn_tries,
    url_filter,
)
from passband.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document, taken as the file ``source/lang/doc_id``."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licences.licences(docs.select("doc_id", path.alias("path"), "text"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(language.learning(docs)))
    found = language.identified(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(~language.learning(docs), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "accepted",
    )


def archive(pages: DataFrame) -> DataFrame:
    """The records of two crawls of ``pages``, in the order of page_id.

    The first asks for every page on condition, with the tag of what it will get, and then gets it
    in full.  The second asks again and learns that it is as it was.
    """
    tag, base = F.md5("html"), F.col("page_id").cast("bigint")
    text = lambda c: c.cast("string")
    known = pages.filter("page_id IS NOT NULL").select(base.alias("page_id"), "url", tag.alias("etag"), F.length("html").alias("size"))

    def revisit(number):
        headers = F.create_map(
            F.lit("date"), F.concat(F.lit("v"), text(number)), F.lit("etag"), F.col("etag"), F.lit("server"), F.lit("cache")
        )
        return known.select(
            number.alias("record_id"), F.lit("revisit").alias("kind"), "url", "etag",
            F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"),
        )

    number = base * 2 + 1
    headers = F.create_map(
        F.lit("content-length"), text(F.col("size")), F.lit("content-type"), F.lit("text/html"),
        F.lit("date"), F.concat(F.lit("r"), text(number)), F.lit("etag"), F.col("etag"),
    )
    full = known.select(
        number.alias("record_id"), F.lit("response").alias("kind"), "url", "etag",
        F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"), F.col("etag").alias("digest"),
    )
    return revisit(base * 2).unionByName(full).unionByName(revisit(base + (1 << 40)))


def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = revisits.resolved(archive(table(spark, folder, "pages").select("page_id", "url", "html")))
    listed = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return found.select(
        "record_id", "url", "response_id", "status", "digest", F.array_join(listed, ";").alias("headers")
    )


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(html) AS etag, length(html) AS size,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1, 's')) AS head
  FROM pages WHERE page_id IS NOT NULL
), r AS (
  SELECT *, regexp_replace(substr(url, length(head) + 1), '#.*$', '', 's') AS rest FROM p
), q AS (
  SELECT *, regexp_replace(regexp_extract(rest, '^([^?]*)', 1, 's'), '(/index\.html?|\.html?)?/*$', '', 's') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1, 's'), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)', 'i'))) AS args
  FROM r
), c AS (
  SELECT page_id, etag, size,
         CASE WHEN head = '' THEN url ELSE
           regexp_replace(regexp_replace(regexp_replace(head, '^http://(.*):80$', 'http://\1'), '^https://(.*):443$', 'https://\1'), '^http://', 'https://')
           || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS url
  FROM q
), v AS (
  SELECT page_id * 2 AS record_id, url, etag FROM c
  UNION ALL SELECT page_id + 1099511627776, url, etag FROM c
), f AS (SELECT page_id * 2 + 1 AS response_id, url, etag, size FROM c)
SELECT v.record_id, v.url, f.response_id,
       CASE WHEN f.response_id IS NULL THEN 'missing' WHEN v.etag = f.etag THEN 'resolved' ELSE 'stale' END AS status,
       CASE WHEN v.etag = f.etag THEN f.etag END AS digest,
       CASE WHEN v.etag = f.etag
            THEN 'content-length=' || f.size || ';content-type=text/html;date=v' || v.record_id || ';etag=' || v.etag
            ELSE 'date=v' || v.record_id || ';etag=' || v.etag || ';server=cache' END AS headers
FROM v ASOF LEFT JOIN f ON v.url = f.url AND v.record_id > f.response_id
"""


def op4_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op6_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.digests(table(spark, folder, "documents"), BYTE_BPE)


def op7_quality_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    found = perplexity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return perplexity.judged(found).drop("text_key")


def op8_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


def op8_sql(steps: int = 150) -> str:
    """Rules, seeds and ranks as SQL; ranks are followed for so many steps, far beyond where they settle."""
    fits = lambda r, h, p: (
        f"({h} = '{r.host}' OR ends_with({h}, '.{r.host}')) AND starts_with({p}, '{r.path}')"
    )
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    case = lambda part, h, p: "CASE " + " ".join(f"WHEN {fits(r, h, p)} THEN '{getattr(r, part)}'" for r in ordered) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = lambda c: f"coalesce(translate(regexp_extract({c}, '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{lower}'), '')"
    path = lambda c: f"coalesce(regexp_extract({c}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
    parts = [
        f"u AS MATERIALIZED (SELECT page_id, {host('url')} AS host, {path('url')} AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT *, {case('name', 'host', 'path')} AS rule, {case('verdict', 'host', 'path')} AS rv FROM u)",
        "l AS (SELECT url, unnest(regexp_extract_all(html, 'href\\s*=\\s*[\"'']?([a-z][a-z0-9+.-]*://[^\"''\\s>]*)', 1, 'i')) AS link FROM pages)",
        f"e0 AS (SELECT {host('url')} AS src, {host('link')} AS dst, {path('link')} AS path FROM l)",
        f"e1 AS MATERIALIZED (SELECT src, dst, {case('verdict', 'dst', 'path')} AS rv FROM e0 WHERE src <> '' AND dst <> '' AND src <> dst)",
        "e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM e1 GROUP BY ALL)",
        # pages of a host and links to it tell together what it is
        f"""h AS MATERIALIZED (SELECT host, avg((coalesce(rv, '') = 'allow')::INT) FILTER (told) > {url_filter.SEED_SHARE} AS trusted,
                     avg((coalesce(rv, '') = 'block')::INT) FILTER (told) > {url_filter.SEED_SHARE} AS blocked FROM (
              SELECT host, rv, true AS told FROM j WHERE host <> '' UNION ALL SELECT dst, rv, true FROM e1 UNION ALL SELECT src, NULL, false FROM e)
            GROUP BY host)""",
    ]
    d = url_filter.DAMPING
    for name, seed, src, dst in (("t", "trusted", "src", "dst"), ("x", "blocked", "dst", "src")):
        parts += [
            f"{name}s AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM e)",
            f"{name}b AS MATERIALIZED (SELECT host, CASE WHEN {seed} THEN 1.0::DOUBLE / (SELECT count(*) FROM h WHERE {seed}) ELSE 0 END AS start FROM h)",
            f"""{name}r AS (
              SELECT 0 AS k, host, start AS rank FROM {name}b WHERE EXISTS (SELECT 1 FROM e)
              UNION ALL
              SELECT k, host, start * ({1 - d} + {d} * (1 - coalesce(sum(got) OVER (), 0))) + {d} * coalesce(got, 0)
              FROM (SELECT (SELECT max(k) + 1 FROM {name}r) AS k, b.host, start, got FROM {name}b b LEFT JOIN (
                      SELECT dst AS host, sum(rank * share) AS got FROM {name}r JOIN {name}s ON host = src GROUP BY dst) g ON g.host = b.host
                    WHERE (SELECT max(k) FROM {name}r) < {steps}) i)""",
            f"{name} AS (SELECT host, rank FROM {name}r WHERE k = {steps} UNION ALL SELECT host, start FROM {name}b WHERE NOT EXISTS (SELECT 1 FROM e))",
        ]
    n = "(SELECT count(*) FROM h)"
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT page_id, j.host, path, rule,
       coalesce(rv, CASE WHEN x.rank * {n} > {url_filter.FLOOR} AND x.rank > t.rank THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN t ON j.host = t.host LEFT JOIN x ON j.host = x.host"""
    )


def op9_compression_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.sequences(packing.pieces(table(spark, folder, "documents"), WORD_BPE))


def op11_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.near_vectors(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turn_tries.prefix_trie(table(spark, folder, "conversations"))


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.clustered(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_language_id,
        op3_warc_revisits,
        op4_simhash_duplicates,
        op5_nearest_neighbours,
        op6_bpe_round_trip,
        op7_quality_perplexity,
        op8_url_verdicts,
        op9_compression_rules,
        op10_best_fit_packing,
        op11_embedding_duplicates,
        op12_prefix_trie,
        op13_centroid_clusters,
    )
}

ORACLES: dict[str, str] = {
    "op3_warc_revisits": OP3_SQL,
    "op8_url_verdicts": op8_sql(),
    "op11_embedding_duplicates": quantised.SQL,
    "op12_prefix_trie": turn_tries.sql(),
    "op13_centroid_clusters": pivots.sql(),
}
