"""Resolving not-modified revisits of an archive to the responses they stand for (operator 3).

A revisit says that a url had not changed.  It is resolved as of its time: the latest earlier full
response of the same canonical url, if its validators agree.  The response gives the body, the
revisit may update the headers that a not-modified answer is allowed to carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passband.operators.ordered import carry

#: Headers that a not-modified answer may renew (a fixed list of the HTTP caching rules).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not change a page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
#: Captures of one url per slice of the as-of join are those of so many record numbers.
WIDTH = 1 << 20


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking parameters, index or final slash.

    Null and empty urls, and what has no ``://``, stay as they are.
    """
    head = F.lower(F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    rest = F.regexp_replace(rest, r"(?s)#.*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^?]*)", 1), r"(?s)(/index\.html?|\.html?)?/*$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{TRACKING}(=|$)"))
    )
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    host = F.regexp_replace(F.regexp_replace(head, r"^http://(.*):80$", "http://$1"), r"^https://(.*):443$", "https://$1")
    host = F.regexp_replace(host, "^http://", "https://")
    return F.when(head == "", url).otherwise(F.concat(host, path, query))


def resolved(records: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every revisit of ``records`` with the response it stands for.

    ``records``: record_id (bigint, unique, in order of time), kind (``response`` or ``revisit``),
    url, etag, last_modified, headers (map of lower-case names), digest.  Returned: record_id, url
    (canonical), response_id, status, digest, headers.  The status is ``resolved``, ``stale`` where a
    validator that both carry differs, or ``missing`` where there is no earlier response; the last
    two have no digest and keep the revisit's own headers.  A null url matches nothing; a record
    whose kind is neither is left out.  A repeated record_id is an error of the archive: any of its
    responses may be taken.

    The as-of join carries the last response along record numbers per url in slices of bounded
    size, so a url may hold a third of all captures.  What is carried is a number; headers are then
    joined by it.
    """
    rows = records.filter(F.col("record_id").isNotNull() & F.col("kind").isin("response", "revisit"))
    rows = rows.select(
        "record_id", "kind", canonical(F.col("url")).alias("url"), "etag", "last_modified", "headers", "digest"
    )
    order = rows.select("record_id", "url", "kind").withColumn(
        "_number", F.when(F.col("kind") == "response", F.col("record_id"))
    )
    last = carry(
        order, ["url"], "record_id", highs_before={"response_id": F.col("_number")}, width=width
    ).filter("kind = 'revisit' AND url IS NOT NULL").select("record_id", "response_id")
    full = rows.filter("kind = 'response'").select(
        F.col("record_id").alias("response_id"),
        F.col("etag").alias("_etag"),
        F.col("last_modified").alias("_modified"),
        F.col("headers").alias("_headers"),
        F.col("digest").alias("_digest"),
    )
    asked = rows.filter("kind = 'revisit'").join(last, "record_id", "left").join(full, "response_id", "left")
    # the strong validator decides where both have it
    agrees = F.coalesce(
        F.col("etag") == F.col("_etag"), F.col("last_modified") == F.col("_modified"), F.lit(True)
    )
    status = (
        F.when(F.col("response_id").isNull(), "missing").when(agrees, "resolved").otherwise("stale")
    )
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("headers", none)
    renewed = F.map_filter(own, lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    merged = F.map_concat(
        F.map_filter(F.coalesce("_headers", none), lambda k, v: ~F.map_contains_key(renewed, k)), renewed
    )
    return asked.select(
        "record_id",
        "url",
        "response_id",
        status.alias("status"),
        F.when(status == "resolved", F.col("_digest")).alias("digest"),
        F.when(status == "resolved", merged).otherwise(own).alias("headers"),
    )
