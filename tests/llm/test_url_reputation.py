import math

import pytest

from chunkwright.llm import url_reputation as U

CASES = [
    ("http://www.Example.co.uk:80/en/12?x#y", "www.example.co.uk", "co.uk", "example.co.uk", 12),
    ("https://user:pw@a.b.example.com./x/y/7.html", "a.b.example.com", "com", "example.com", 7),
    ("//host/1", "host", "host", "host", 1),
    ("http://10.0.0.1/5", "10.0.0.1", "10.0.0.1", "10.0.0.1", 5),
    ("http://co.uk/3", "co.uk", "co.uk", "co.uk", 3),
    ("not a url", "", "", "", None),
    ("", "", "", "", None),
    (None, "", "", "", None),
    ("http://x.org/a/99999999999999999999999", "x.org", "org", "x.org", None),
]


def test_parts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "page_id bigint, url string")
    h = U.host_of(F.col("url"))
    got = df.select("page_id", h.alias("h"), U.suffix_of(h).alias("s"), U.domain_of(h, U.suffix_of(h)).alias("d")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:4] for c in CASES]
    labels = spark.createDataFrame([(c[4], 1, 0) for c in CASES if c[4]], "doc_id bigint, quality int, toxic int")
    assert [r.good for r in U.outcomes(df, labels).orderBy("page_id").collect()] == [1 if c[4] else None for c in CASES]


def strength(nodes):
    some = [(g, n) for g, n in nodes if n >= 2]
    if len(some) < 2:
        return 10.0
    sg, sn, snn = sum(g for g, _ in some), sum(n for _, n in some), sum(n * n for _, n in some)
    p = sg / sn
    s = sum(n * (g / n - p) ** 2 for g, n in some) / (len(some) - 1)
    m = (sn - snn / sn) / (len(some) - 1)
    if not p * (1 - p) > 0 or m <= 1:
        return 10.0
    rho = (s - p * (1 - p)) / ((m - 1) * p * (1 - p))
    return 1000.0 if rho <= 1 / 1001 else max(1 / rho - 1, 1.0)


def test_against_plain_python(spark):
    pages, labels, by_host = [], [], {}
    for i in range(400):
        host = f"h{i % 7}.d{i % 13}.{('com', 'org', 'co.uk')[i % 3]}"
        good = int((i * 7919) % 13 > i % 13)
        pages.append((i, f"http://{host}/{i}", "x"))
        if i % 5:
            labels.append((i, 1, 1 - good))
        n, g = by_host.get(host, (0, 0))
        by_host[host] = (n + bool(i % 5), g + good * bool(i % 5))
    suffix = lambda h: "co.uk" if h.endswith("co.uk") else h.rsplit(".", 1)[1]
    domain = lambda h: h.split(".", 1)[1]
    dom, suf = {}, {}
    for h, (n, g) in by_host.items():
        for table, key in ((dom, domain(h)), (suf, suffix(h))):
            a, b = table.get(key, (0, 0))
            table[key] = (a + n, b + g)
    rates = lambda t: [(g, n) for n, g in t.values()]
    k1, k2, k3 = strength(rates(suf)), strength(rates(dom)), strength(rates(by_host))
    top = sum(g for _, g in suf.values()) / sum(n for n, _ in suf.values())
    ms = {s: (top * k1 + g) / (k1 + n) for s, (n, g) in suf.items()}
    md = {d: (ms[suffix("x." + d)] * k2 + g) / (k2 + n) for d, (n, g) in dom.items()}
    got = U.judge(spark.createDataFrame(pages, "page_id bigint, url string, host string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == 400
    for r in got:
        n, g = by_host[r.host]
        a, b = md[domain(r.host)] * k3 + g, (1 - md[domain(r.host)]) * k3 + n - g
        mean = a / (a + b)
        low = mean - U.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert (r.n_host, r.posterior_mean, r.lower_bound) == (n, pytest.approx(mean, abs=1e-5), pytest.approx(low, abs=1e-5)) and r.keep == (r.lower_bound >= U.KEEP)


def test_nasty(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://a.com/1"), (3, "http://a.com/1"), (None, "http://a.com/" + "x" * 100_000)], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = U.judge(pages, labels).collect()
    assert len(got) == 5 and {r.n_host for r in got if r.host == "a.com"} == {2}
    assert U.judge(pages.limit(0), labels).count() == 0
    assert {r.posterior_mean for r in U.judge(pages, labels.limit(0)).collect()} == {0.5}
