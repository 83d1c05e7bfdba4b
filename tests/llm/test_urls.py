import re

import duckdb
import pytest

from quillmine.llm import queries_urls, urls
from quillmine.llm.queries_urls import RULES


def by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule_by_hand(host, path):
    fits = [(len(r), r, v) for r, v in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "https://A.example.org/es/x", "http://example.org/en/1?q", "http://example.org/en/2", "https://b.com/fr/", "https://b.com/de/x#y", "x://com", "no scheme", None, "", "https://É.NET/a/b?c://d", "http://notorg/es/",
    "https://h.net", "a://b://c/d", "http://example.org", "http://xexample.org/es/", "http://h.net/\nline",
]


def tables(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS)] + [(None, "https://h.net/", None, None), (3, URLS[3], None, None)], "page_id long, url string, html string, host string")
    outcomes = spark.createDataFrame([(0, 1), (1, 0), (11, 1), (11, 0), (None, 1), (5, 7), (99, 1)], "page_id long, good int")
    return pages, outcomes


def test_parts_and_rules(spark):
    rows = urls.url_verdicts(*tables(spark), RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r.page_id is not None:
            assert (r.host, r.path) == by_hand(URLS[r.page_id])
        rule, verdict = rule_by_hand(r.host, r.path)
        assert r.rule == rule and (rule is None or r.verdict == verdict) and r.verdict in ("allow", "block")


def test_posterior_by_hand(spark):
    pages = [(i, f"http://{h}/") for h, n in (("a.x.net", 40), ("b.x.net", 40), ("c.y.net", 2), ("d.z.org", 30)) for i in range(n)]
    good = {"a.x.net": 36, "b.x.net": 4, "c.y.net": 1, "d.z.org": 30}
    counts = {}
    rows, seen = [], 0
    for _, u in pages:
        h = u[7:-1]
        counts[h] = counts.get(h, 0) + 1
        rows.append((h, int(counts[h] <= good[h])))
        seen += 1
    outcomes = spark.createDataFrame(rows, "host string, good int")
    got = {r.host: r for r in urls.host_reputation(outcomes, outcomes.select("host")).collect()}

    def strength(members):
        spread = sum(n * (g / n - r) ** 2 for n, g, r in members)
        noise, pairs = sum(r * (1 - r) for _, _, r in members), sum((n - 1) * r * (1 - r) for n, _, r in members)
        excess = (spread - noise) / pairs
        return min(1000.0, max(1.0, 1 / excess - 1 if excess > 0 else 1000.0))

    total = {h: (counts[h], good[h]) for h in good}
    base = (sum(g for _, g in total.values()) + 1) / (sum(n for n, _ in total.values()) + 2)

    def grouped(key):
        out = {}
        for h, (n, g) in total.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + g)
        return out

    by_suffix, by_domain = grouped(lambda h: h.split(".")[-1]), grouped(lambda h: ".".join(h.split(".")[-2:]))
    k = strength([(n, g, base) for n, g in by_suffix.values()])
    means = {s: (g + k * base) / (n + k) for s, (n, g) in by_suffix.items()}
    k = strength([(n, g, means[d.split(".")[-1]]) for d, (n, g) in by_domain.items()])
    domain = {d: (g + k * means[d.split(".")[-1]]) / (n + k) for d, (n, g) in by_domain.items()}
    k = strength([(n, g, domain[".".join(h.split(".")[-2:])]) for h, (n, g) in total.items()])
    for h, (n, g) in total.items():
        mean = (g + k * domain[".".join(h.split(".")[-2:])]) / (n + k)
        assert got[h]["mean"] == pytest.approx(mean)
        assert got[h].bound == pytest.approx(mean - urls.Z * (mean * (1 - mean) / (n + k + 1)) ** 0.5)
    assert got["a.x.net"].bound > got["b.x.net"].bound and abs(got["c.y.net"]["mean"] - 0.5) < 0.4


def test_both_joins_agree(spark, monkeypatch):
    pages, outcomes = tables(spark)
    one = sorted(map(repr, urls.url_verdicts(pages, outcomes, RULES).collect()))
    monkeypatch.setattr(urls, "BROADCAST_HOSTS", 0)
    assert sorted(map(repr, urls.url_verdicts(pages, outcomes, RULES).collect())) == one


def test_empty_and_unlabelled(spark):
    pages, outcomes = tables(spark)
    assert urls.url_verdicts(pages.limit(0), outcomes, RULES).count() == 0
    assert urls.url_verdicts(pages, outcomes.limit(0), RULES).count() == pages.count()
    with pytest.raises(ValueError):
        urls.rule_for(pages.host, pages.url, [("a/", "allow")] * 1001)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.sql(queries_urls.SQL["op3_host_reputation"])
    got = queries_urls.op3_host_reputation(spark, sf).select(*found.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
