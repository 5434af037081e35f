"""Operator 3: as-of resolution against a loop over records in time order."""

import random

import pytest

from passband.llm import revisits


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Ex.COM:80/a/index.html?utm_source=f&b=2&a=1#x", "https://ex.com/a?a=1&b=2"),
        ("https://ex.com/a.html", "https://ex.com/a"), ("https://ex.com/A/", "https://ex.com/A"), ("https://ex.com", "https://ex.com"),
        ("https://ex.com:443/?ref=x", "https://ex.com"), ("https://ex.com/?q=a&&reference=1", "https://ex.com?q=a&reference=1"),
        ("no scheme", "no scheme"), ("", ""), (None, None),
    ],
)
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(revisits.canonical(df.u)).first()[0] == want


SCHEMA = "record_id bigint, kind string, url string, etag string, last_modified string, headers map<string,string>, digest string, response_id int"


def test_against_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        url = rng.choice(["http://a.b/x", "https://A.b/x/", "https://c.d/?ref=1", None, "https://only.once/"])
        etag, modified = rng.choice([None, "e1", "e2"]), rng.choice([None, "m1", "m2"])
        headers = rng.choice([None, {"date": f"d{i}", "server": f"s{i}"}, {"etag": None, "expires": f"x{i}"}, {"content-type": "t", "date": f"d{i}"}])
        rows.append((i * 3, kind, url, etag, modified, headers, f"g{i}", 7))
    rows.append((None, "revisit", "http://a.b/x", None, None, None, None, 7))
    last, want = {}, {}
    names = {"http://a.b/x": 1, "https://A.b/x/": 1, "https://c.d/?ref=1": 2, "https://only.once/": 3}
    for i, kind, url, etag, modified, headers, digest, _ in rows[:-1]:
        key = names.get(url)
        if kind == "response" and key:
            last[key] = (i, etag, modified, headers or {}, digest)
        elif kind == "revisit":
            seen, own = last.get(key) if key else None, headers or {}
            if not seen:
                want[i] = (None, "missing", None, own)
                continue
            if etag and seen[1]:
                same = etag == seen[1]
            else:
                same = modified == seen[2] if modified and seen[2] else True
            renewed = {k: v for k, v in own.items() if k in revisits.RENEWED and v is not None}
            merged = {**seen[3], **renewed}
            want[i] = (seen[0], "resolved" if same else "stale", seen[4] if same else None, merged if same else own)
    df = spark.createDataFrame(rows, SCHEMA)
    for width in (16, 1 << 20):
        got = {r.record_id: (r.response_id, r.status, r.digest, r.headers) for r in revisits.resolved(df, width).collect()}
        assert got == want
    assert {w[1] for w in want.values()} == {"resolved", "stale", "missing"}
    assert revisits.resolved(df.limit(0)).count() == 0
