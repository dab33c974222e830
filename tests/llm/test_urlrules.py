"""Operator 11: the sweep and the judged URLs against brute force."""

import random

from pyspark.sql import functions as F

from tabforge.llm.urlrules import judge_urls, sweep


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    rest = rest[:end]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules):
    host, path = parts(url)
    fits = {}
    for h, p, v in rules:
        if None in (h, p, v) or set(h) & set("/?#"):
            continue
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits[h, p] = max(v, fits.get((h, p), v))
    if not fits:
        return host, path, None, "allow"
    h, p = max(fits, key=lambda k: (len(k[0]) + len(k[1]), len(k[0])))
    return host, path, h + p, fits[h, p]


def test_sweep_finds_all_prefixes(spark):
    rnd = random.Random(3)
    def word(n):
        return "".join(rnd.choice("ab.é\U0010FFFF/") for _ in range(rnd.randrange(n)))
    prefixes = sorted({word(5) for _ in range(120)})
    points = [(i, word(12)) for i in range(900)] + [(1000, None)]
    p = spark.createDataFrame(points, "rule int, key string")
    r = spark.createDataFrame([(x, x) for x in prefixes] + [(None, "none")], "prefix string, rule string")
    for rows in (100, 1 << 18):
        pts = p.withColumnRenamed("rule", "id")
        got = sorted((x.id, x.rule) for x in sweep(pts, r, rows).collect())
        want = sorted((i, q) for i, k in points if k is not None for q in prefixes if k.startswith(q))
        assert got == want
        top = sorted((x.id, x.rule) for x in sweep(pts, r, rows, levels=False).collect())
        assert top == sorted({i: q for i, q in sorted(want, key=lambda z: (z[0], len(z[1])))}.items())


def test_judged_urls(spark):
    rnd = random.Random(4)
    labels = ["a", "b", "com", "net", "x-y", "", "é", "a:80"]
    def host():
        return ".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 5)))
    def path():
        return rnd.choice(["", "/", "//", "/en", "/en/", "/en/a", "/de/é", "/en/a/b", "/EN/"])
    rules = [(host(), path(), rnd.choice(["allow", "block"])) for _ in range(150)]
    rules += [("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("b", None, "block"), ("a", "/en", None), ("a/b", "", "block"), ("NET", "/en/", "block")]
    urls = [rnd.choice(["http", "https", ""]) + "://" + rnd.choice([host(), host().upper()]) + path() + rnd.choice(["", "?q=/en/", "#t", "?a#b", "z"]) for _ in range(700)]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://com", "http://COM/en/\n/x", "http:///en/", "http://" + "a." * 300 + "com/" + "x" * 5000] + urls[:40]
    hot = ["http://b.a.com/en/a/%d" % (i % 3) for i in range(500)]
    rows = [(i if i % 7 else None, u, "h", "p", "r", "v", 1) for i, u in enumerate(urls + hot)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, _k string, best int")
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    for n in (60, 1 << 18):
        got = judge_urls(pages, df, range_rows=n).collect()
        assert len(got) == len(rows)
        for x in got:
            assert (x.host, x.path, x.rule, x.verdict) == judge(x.page.url, rules), x.page.url
    assert sorted((r.page.page_id is None, r.page.page_id or 0, r.page.url or "") for r in got) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    none = judge_urls(pages, df.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}
    assert judge_urls(pages.limit(0), df).collect() == []


def test_plan_has_no_python(spark):
    df = judge_urls(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string").select(F.col("page_id"), F.col("url")),
                    spark.sql("select * from values ('net', '/', 'block') as t(host, path, verdict)"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
