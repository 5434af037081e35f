"""Operator 8: rules, and ranks against a dense matrix version."""

import random

import duckdb
import numpy as np
import pytest

from passband.llm import queries, url_filter
from passband.llm.url_filter import Rule

RULES = (Rule("allow", "good.org"), Rule("block", "bad.net"), Rule("block", "half.com", "/de/"), Rule("allow", "bad.net", "/en/"))
LINKS = {
    "good.org": ["near.org", "near.org", "far.org"],
    "near.org": ["far.org", "HTTP.example"],
    "lure.biz": ["bad.net", "bad.net", "near.org"],
    "bait.biz": ["lure.biz"],
    "bad.net": ["good.org", "lure.biz"],
    "half.com": ["good.org"],
}
PATHS = {"bad.net": ["/x", "/en/a", "/y"], "half.com": ["/de/1", "/fr/1", "/fr/2"]}


def pages(spark):
    rows, n = [], 0
    for host, out in LINKS.items():
        for k, path in enumerate(PATHS.get(host, ["/", "/a"])):
            html = "".join(f'<a HREF = "https://{h}/p?x#y">t</a><a href=/local>l</a><a href=\'mailto:a@b\'>m</a>' for h in out) if k == 0 else None
            rows.append((n, f"https://{host}{path}", html, "h", "p"))
            n += 1
    rows += [(900, None, None, "", ""), (901, "no scheme", "<a href='http://far.org/'>", "", ""), (902, "http://", "", "", ""), (None, "https://lure.biz/z", None, "", ""), (3, "https://lure.biz/z", None, "", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, path string")


def ranks(hosts, edges, seeds, steps):
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}
    share = np.zeros((n, n))
    for (a, b), k in edges.items():
        share[at[a], at[b]] += k
    sums = share.sum(axis=1, keepdims=True)
    share = np.divide(share, sums, out=np.zeros_like(share), where=sums > 0)
    start = np.array([1 / len(seeds) if h in seeds else 0.0 for h in hosts])
    rank = start
    for _ in range(steps):
        got = rank @ share
        rank = start * ((1 - url_filter.DAMPING) + url_filter.DAMPING * (1 - got.sum())) + url_filter.DAMPING * got
    return dict(zip(hosts, rank * n))


def test_ranks_and_verdicts(spark):
    df = pages(spark)
    ruled = url_filter.ruled(df.drop("host", "path"), RULES)
    edges = {}
    for a, out in LINKS.items():
        for b in out:
            edges[a, b.lower()] = edges.get((a, b.lower()), 0) + 1
    links = url_filter.host_links(df)
    assert {(r.src, r.dst): r.n for r in links.collect()} == edges
    hosts = sorted({*LINKS, *(b for _, b in edges)})
    got = {r.host: r for r in url_filter.host_verdicts(ruled, links).collect()}
    assert sorted(got) == hosts
    trust = ranks(hosts, edges, {"good.org"}, 300)
    distrust = ranks(hosts, {(b, a): n for (a, b), n in edges.items()}, {"bad.net"}, 300)
    for h in hosts:
        assert got[h].trust == pytest.approx(trust[h], abs=url_filter.SETTLED) and got[h].distrust == pytest.approx(distrust[h], abs=url_filter.SETTLED)
    assert got["lure.biz"].host_verdict == "block" and got["bait.biz"].host_verdict == "block"
    assert got["near.org"].host_verdict == "allow" and got["half.com"].host_verdict == "allow"
    rows = url_filter.judged(df, RULES).collect()
    assert len(rows) == df.count()
    by = {(r.host, r.path): (r.rule, r.verdict) for r in rows}
    assert by["bad.net", "/en/a"] == ("bad.net/en/", "allow") and by["bad.net", "/x"] == ("bad.net/", "block")
    assert by["half.com", "/de/1"] == ("half.com/de/", "block") and by["half.com", "/fr/1"] == (None, "allow")
    assert by["lure.biz", "/z"] == (None, "block") and by["", ""] == (None, "allow")


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://notexample.com/de/x", "notexample.com", "/de/x", None, None),
        ("http://x.org?u=/fr/", "x.org", "", None, None),
        ("ftp://b.org/fr/#a", "b.org", "/fr/", "org/fr/", "allow"),
        ("x://y://z.net/en/", "y:", "//z.net/en/", None, None),
        ("https://net/", "net", "/", "net/", "block"),
        ("https://a.net:80/", "a.net:80", "/", None, None),
        ("a\nb://C.net/\nd", "c.net", "/\nd", "net/", "block"),
        ("mailto:x", "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id bigint, url string")
    r = url_filter.ruled(df).first()
    assert (r.host, r.path, r.rule, r.rule_verdict) == (host, path, rule, verdict)


def test_linked_hosts_that_were_not_fetched_are_seeds(spark):
    html = lambda *urls: "".join(f"<a href='{u}'>t</a>" for u in urls)
    rows = [
        (1, "https://lure.biz/", html("http://x.net/a", "http://X.net/b", "http://y.net/")),
        (2, "https://plain.biz/", html("http://o.org/fr/1", "http://example.com/de/1", "http://example.com/fr/1", "http://example.com/fr/2")),
        (3, "https://other.biz/", None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    edges = url_filter.host_links(df, url_filter.RULES)
    assert {(r.src, r.dst): (r.n, r.allow, r.block) for r in edges.collect()} == {
        ("lure.biz", "x.net"): (2, 0, 2), ("lure.biz", "y.net"): (1, 0, 1),
        ("plain.biz", "o.org"): (1, 1, 0), ("plain.biz", "example.com"): (3, 0, 1),
    }
    got = {r.host: r for r in url_filter.host_verdicts(url_filter.ruled(df), edges).collect()}
    hosts, linked = sorted(got), {("lure.biz", "x.net"): 2, ("lure.biz", "y.net"): 1, ("plain.biz", "o.org"): 1, ("plain.biz", "example.com"): 3}
    trust = ranks(hosts, linked, {"o.org"}, 300)
    distrust = ranks(hosts, {(b, a): n for (a, b), n in linked.items()}, {"x.net", "y.net"}, 300)
    for h in hosts:
        assert got[h].trust == pytest.approx(trust[h], abs=url_filter.SETTLED) and got[h].distrust == pytest.approx(distrust[h], abs=url_filter.SETTLED)
    assert {r.host: r.verdict for r in url_filter.judged(df).collect()} == {"lure.biz": "block", "plain.biz": "allow", "other.biz": "allow"}


def test_query_and_sql_agree_on_a_graph(spark):
    """Chains longer than any fixed number of steps, a hub, a cycle and odd rows, against the SQL."""
    rng, rows = random.Random(3), []
    link = lambda *hosts: "".join(f"<a href='http://{h}/de/p'>t</a>" for h in hosts)
    hosts = [f"h{i}.biz" for i in range(40)]
    for i in range(30):  # a chain that ends at a blocked host, another that begins at a trusted one
        rows.append((i, f"https://c{i}.biz/", link(f"c{i + 1}.biz" if i < 29 else "x.net")))
        rows.append((100 + i, f"https://t{i}.org/fr/" if i == 0 else f"https://t{i}.biz/", link(f"t{i + 1}.biz")))
    for i, h in enumerate(hosts):
        rows.append((200 + i, f"http://{h}/a?b", link(*rng.sample([*hosts, "x.net", "y.net", "z.org", "example.com"], 4))))
    rows += [(300 + i, "https://hub.biz/", link(f"s{i}.net", "hub2.biz")) for i in range(40)]
    rows += [(400, None, None), (401, "x", link("x.net")), (None, "https://hub2.biz/", link("hub.biz")), (200, "http://h0.biz/q", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = url_filter.judged(df, settled=0.2).toPandas()
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(queries.op8_sql()).df()
    shape = lambda t: sorted(map(repr, t[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(t.notna(), None).values.tolist()))
    assert shape(got.astype({"page_id": "Int64"})) == shape(want.astype({"page_id": "Int64"}))
    assert set(got.verdict[got.rule.isna()]) == {"allow", "block"}  # ranks decide both ways


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.judged(empty).count() == 0
