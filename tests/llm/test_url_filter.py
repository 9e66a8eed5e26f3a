from __future__ import annotations

import math

import pytest

from larkspur.llm.url_filter import RULES, Z, filter_urls, host_reputation

PAGES = "page_id long, url string, html string"


def plain(url: str | None) -> tuple[str, str, str | None, str | None]:
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.mark.parametrize("url", [
    None, "", "no-scheme/x", "http://WWW.Example.COM/en/a?b#c", "http://example.com/en/", "http://a.example.com/fr/", "http://x.net/es/1", "http://x.net/ES/1", "net://net/fr/", "http://net",
    "http://xnet/fr/", "http://a.org?x=/en/", "http://a.org#://b", "a://b://c/d", "://", "http://ÉA.net/es/", "http://com", "http://com/", "http://user:80/x",
])
def test_parts_and_rules_equal_plain_ones(spark, url):
    r = filter_urls(spark.createDataFrame([(1, url, "")], PAGES)).first()
    host, path, rule, action = plain(url)
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == (action or r.verdict) and r.verdict in ("allow", "block")


def test_reputation_equals_a_plain_computation(spark):
    outcomes = [("a.x.net", 1)] * 9 + [("a.x.net", 0)] + [("b.x.net", None)] * 3 + [("c.y.net", 0)] * 5 + [("d.z.org", None)] + [("e.co.uk", 1), ("e.co.uk", 0)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}

    def strength(groups):
        known = [g for g in groups if g[0] > 0]
        v = sum(m * (1 - m) for _, _, m, _ in known)
        over = sum(n * (k / n - m) ** 2 for n, k, m, _ in known) - v
        top = sum(m * (1 - m) * (n - 1) for n, k, m, _ in known)
        return 1.0 if not top else 1000.0 if over <= 0 else min(1000.0, max(1.0, top / over - 1))

    def shrunk(groups):
        s, out = strength(list(groups.values())), {}
        for key, (n, k, m, var) in groups.items():
            a, b = k + s * m, n - k + s * (1 - m)
            out[key] = (a / (n + s), a * b / ((n + s) ** 2 * (n + s + 1)) + (s / (n + s)) ** 2 * var)
        return out

    suffix_of = lambda h: "co.uk" if h.endswith("co.uk") else h.split(".")[-1]
    domain_of = lambda h: ".".join(h.split(".")[-3 if h.endswith("co.uk") else -2 :])
    hosts = {h: (sum(b is not None for x, b in outcomes if x == h), sum(b or 0 for x, b in outcomes if x == h)) for h, _ in outcomes}
    total = [sum(x) for x in zip(*hosts.values())]
    m0 = (total[1] + 0.5) / (total[0] + 1)
    sums = lambda of, prior: {key: (*[sum(x) for x in zip(*(v for h, v in hosts.items() if of(h) == key))], *prior(key)) for key in set(map(of, hosts))}
    suffixes = shrunk(sums(suffix_of, lambda key: (m0, 0.0)))
    domains = shrunk(sums(domain_of, lambda key: suffixes[next(suffix_of(h) for h in hosts if domain_of(h) == key)]))
    final = shrunk({h: (*v, *domains[domain_of(h)]) for h, v in hosts.items()})
    for h, (mean, var) in final.items():
        assert got[h].mean == pytest.approx(mean) and got[h].lower == pytest.approx(mean - Z * math.sqrt(var))
    assert got["a.x.net"].lower > got["c.y.net"].lower and got["b.x.net"].mean > got["d.z.org"].mean


def test_hosts_that_are_blocked_often_are_blocked_elsewhere_too(spark):
    rows = [(i, f"http://bad.x.net/es/{i}", "") for i in range(60)] + [(100 + i, f"http://good.com/{i}", "") for i in range(60)] + [(90, "http://bad.x.net/other", ""), (91, "http://new.org/", "")]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[90] == "block" and got[91] == "allow"


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", ""), (2, "http://h/x", "y"), (2, "http://h/x", "y")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'c' as host", "'c' as path", "'c' as rule", "'c' as verdict", "1 as id", "2 as action", "3 as n")
    got = filter_urls(pages).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"} and {r.page_id for r in got} == {None, 1, 2}
    assert filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("host, want", [
    ("a.b.example.org", ("org", "example.org")), ("www.x.co.uk", ("co.uk", "x.co.uk")), ("x.com.au:8080", ("com.au", "x.com.au")), ("user:pw@h.y.net:1", ("net", "y.net")),
    ("10.0.0.1:80", ("10.0.0.1", "10.0.0.1")), ("[::1]:80", ("[::1]", "[::1]")), ("localhost", ("localhost", "localhost")), ("", ("", "")), ("co.uk", ("co.uk", "co.uk")), ("x.fr", ("fr", "x.fr")),
])
def test_suffix_and_domain(spark, host, want):
    from larkspur.llm.url_filter import suffix_and_domain

    df = spark.createDataFrame([(host,)], "host string")
    assert tuple(df.select(*suffix_and_domain(df["host"])).first()) == want


def test_verdicts_by_reputation_are_clear_of_the_cut(spark, small_dir):
    from larkspur.llm.url_filter import BLOCK_AT

    rows = filter_urls(spark.read.parquet(f"{small_dir}/pages.parquet")).where("rule is null").collect()
    assert rows and all(abs(r.reputation - BLOCK_AT) > 0.05 and r.verdict == ("block" if r.reputation >= BLOCK_AT else "allow") for r in rows)


def test_a_very_long_url(spark):
    url = "https://" + "a." * 50_000 + "net/es/" + "x" * 1_000_000 + "?q"
    r = filter_urls(spark.createDataFrame([(1, url, "")], PAGES)).first()
    assert r.host == "a." * 50_000 + "net" and len(r.path) == 1_000_004 and r.rule == "net/es/" and r.verdict == "block"


def test_hosts_beyond_a_broadcast_are_joined_where_their_pages_are(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    hot = spark.range(2_000).selectExpr("id + 100000 as page_id", "'http://hot.example.org/' as url", "'' as html")
    every = pages.unionByName(hot)
    rows = lambda n: sorted(map(tuple, filter_urls(every, broadcast_rows=n).collect()))
    assert rows(0) == rows(200_000)
