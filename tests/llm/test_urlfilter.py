import re

import pytest

from tideline.llm import urlfilter as u

URLS = [
    (1, "https://www.Example.com/en/1?x#y", "allow", "www.example.com/en/", "www.example.com", "/en/1"),
    (2, "https://m.example.com/en/", "block", "example.com/en/", "m.example.com", "/en/"),
    (3, "https://m.example.com/en", "allow", "com/", "m.example.com", "/en"),
    (4, "http://other.com", None, None, "other.com", ""),
    (5, "http://notexample.com/en/2", "allow", "com/", "notexample.com", "/en/2"),
    (6, "http://a.net/es/1", "block", "net/es/", "a.net", "/es/1"),
    (7, "http://net/fr/?q=/x", "block", "net/fr/", "net", "/fr/"),
    (8, "http://anet/fr/", None, None, "anet", "/fr/"),
    (9, None, None, None, "", ""),
    (10, "no scheme", None, None, "", ""),
    (11, "x://H?a://b/c", None, None, "h", ""),
    (12, "http://a.org#/es/", None, None, "a.org", ""),
    (13, "", None, None, "", ""),
    (14, "http://É.COM/a", "allow", "com/", "É.com", "/a"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, url, None, "x") for i, url, *_ in URLS] + [(1, URLS[0][1], None, "x")], "page_id long, url string, html string, rule string")
    got = u.judge(df).collect()
    assert len(got) == len(URLS) + 1
    by_id = {r["page_id"]: r for r in got}
    for i, _, verdict, rule, host, path in URLS:
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), i
        assert r["verdict"] == (verdict or "allow")
    assert u.judge(df.limit(0)).count() == 0


def brute(edges, seeds, damping=u.DAMPING, steps=300):
    hosts = {h for e in edges for h in e[:2]} | set(seeds)
    outs, ins = {}, {}
    for a, b, n in edges:
        outs[a], ins[b] = outs.get(a, 0) + n, ins.get(b, 0) + n
    g, b_ = (sum(s[k] for s in seeds.values()) or 1 for k in (0, 1))
    t = {h: (1 - damping) * seeds.get(h, (0, 0))[0] / g for h in hosts}
    d = {h: (1 - damping) * seeds.get(h, (0, 0))[1] / b_ for h in hosts}
    t0, d0 = dict(t), dict(d)
    for _ in range(steps):
        t1, d1 = dict(t0), dict(d0)
        for a, b, n in edges:
            t1[b] += damping * t[a] * n / outs[a]
            d1[a] += damping * d[b] * n / ins[b]
        t, d = t1, d1
    return t, d


def test_propagation_against_brute_force(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 5), ("d", "bad", 4), ("e", "d", 1), ("e", "a", 1), ("b", "bad", 1), ("lone", "b", 1)]
    seeds = {"a": (1.0, 0.0), "bad": (0.0, 0.5), "z": (0.5, 0.5)}
    t, d = brute(edges, seeds)
    tables = spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good double, bad double")
    for hub in (u.HUB, 2):  # with hubs spread over several parts too
        rows = {r["host"]: r for r in u.host_scores(*tables, hub=hub).collect()}
        assert set(rows) == set(t)
        for h in t:
            assert rows[h]["trust"] == pytest.approx(t[h], abs=1e-5) and rows[h]["distrust"] == pytest.approx(d[h], abs=1e-5)
    with pytest.raises(RuntimeError):
        u.host_scores(*tables, most=3)


def test_links_and_verdicts(spark):
    bad = '<a href="http://spam.net/es/">x</a> <A class=y HREF=//spam.net/q>again</a>'
    good = "<a href='https://Fine.org/x?http://q'>"
    rows = [(1, "http://spam.net/es/1", ""), (2, "http://near.org/1", bad), (3, "http://near.org/2", bad + '<a href="/own">'), (4, "http://site.com/", good), (5, "http://fine.org/", None), (6, "http://spam.net/x", None), (7, "http://far.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, u.host_links(df).collect())) == [("near.org", "spam.net", 2), ("site.com", "fine.org", 1)]
    got = {r["page_id"]: r["verdict"] for r in u.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow"}


def test_rules_are_the_longest_fit(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in df.collect()}
    for r in u.judge(df).collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0])
        assert best[0] is None or r["verdict"] == best[1]


def test_long_and_broken_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.com/", '<a href="//b.com/x"> <A class=q HREF = \'https://C.com\'>t</a> <a name="//no.com"> <abbr href="//no.com"> <a href="/own"> <a <a href=//d.com'), (2, "http://a.com/2", None), (3, "http://e.com/", '<a href="//b.com"><a href="//b.com">')],
        "page_id long, url string, html string",
    )
    units = ["<a ", "<", '<a href="', "<a href=x:", ">"]
    long = spark.createDataFrame([(10 + i, "http://long.com/", u) for i, u in enumerate(units)], "page_id long, url string, html string")
    long = long.selectExpr("page_id", "url", "concat(repeat(html, CAST(3000000 / length(html) AS int)), '> <a href=\"//end.com\">') AS html")
    got = sorted(map(tuple, u.host_links(pages.unionByName(long)).collect()))
    assert [r for r in got if r[0] != "long.com"] == [("a.com", "b.com", 1), ("a.com", "c.com", 1), ("a.com", "d.com", 1), ("e.com", "b.com", 1)]
    assert ("long.com", "end.com", len(units)) in got
