"""URL filter: rules by hand, and trees that learn from ruled URLs."""

from __future__ import annotations

import random

from plotrows.llm import queries, urlfilter


def split(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:n], rest[n:]
    m = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:m]


def rule_of(url: str | None, rules) -> tuple[str | None, str | None]:
    host, path = split(url)
    best = (0, None, None)
    for verdict, r in rules:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best, (len(r), r, verdict), key=lambda x: x[0])
    return best[1], best[2]


URLS = [None, "", "no scheme", "http://", "https://Example.ORG", "https://example.org/", "https://a.example.org/es/1", "https://example.org/en/1",
        "https://example.org/en/123?x=1", "https://notexample.org/es/", "https://a.com/fr/x", "https://com/de/", "http://x.com/de", "http://x.com/de/?q#f",
        "ftp://y.net?u=http://z.org/", "http://ÄB.org/ü", "//example.org/", "http://a.org#/es/", "x://b\nc.org/d\ne", "http://org/"]


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = urlfilter.Filter(queries.URL_RULES).fit(df).judge(df, ["page_id"]).collect()
    assert len(got) == len(URLS)
    for r in got:
        url = URLS[r.page_id]
        rule, verdict = rule_of(url, queries.URL_RULES)
        assert (r.host, r.path) == split(url), url
        assert r.rule == rule, url
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_given_pages(spark, sf_small):
    urls = {r.page_id: r.url for r in queries.table(spark, sf_small, "pages").collect()}
    got = queries.op4_url_filter(spark, sf_small).collect()
    assert {r.page_id for r in got} == set(urls) and len(got) == len(urls)
    for r in got:
        rule, verdict = rule_of(urls[r.page_id], queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (*split(urls[r.page_id]), rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_trees_learn_from_ruled_urls(spark):
    rng = random.Random(1)
    urls = [f"http://{rng.choice(['a', 'b'])}.good/{rng.choice(['x', 'y'])}/{i}.html" for i in range(200)]
    urls += [f"http://c{i}-{i * 7}-{i * 13}.bad/?a={i}&b={i}&c={rng.random()}" for i in range(200)]
    urls += ["http://z.other/x/5.html", "http://q-7-91.else/?a=9&b=8&c=0.12345"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.Filter([("allow", "good/"), ("block", "bad/")]).fit(df).judge(df, ["page_id"]).collect()}
    assert got[400].rule is None and got[400].verdict == "allow" and got[401].verdict == "block"


def test_one_class_no_rules_no_rows_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.good/", "h"), (1, "http://a.good/", "h"), (2, None, None)], "page_id long, url string, host string")
    got = urlfilter.Filter([("block", "good/")]).fit(df).judge(df, ["page_id"]).collect()
    assert [r.verdict for r in got] == ["block"] * 3
    assert [r.verdict for r in urlfilter.Filter([]).fit(df).judge(df, ["page_id"]).collect()] == ["allow"] * 3
    none = df.where("page_id > 9")
    assert urlfilter.Filter(queries.URL_RULES).fit(none).judge(none, ["page_id"]).collect() == []


def test_shares_are_counted_over_all_ruled_urls_and_the_sample_is_bounded(spark):
    urls = [f"http://h{i % 400}.d{i % 400}.{'good' if i % 3 else 'bad'}/{i}.html" for i in range(1200)] + ["http://same.good/"] * 600
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = urlfilter.Filter([("allow", "good/"), ("block", "bad/")]).fit(df, rows=100, rounds=2)
    want = {}
    for u in urls:
        want.setdefault(".".join(split(u)[0].split(".")[-2:]), []).append(split(u)[0].endswith("bad"))
    rate = 400 / 1800
    got = {r.s_two: r.f_s_two for r in model.shares["s_two"].collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - (sum(x) + 5 * rate) / (len(x) + 5)) < 1e-9 for k, x in want.items())
    labelled = urlfilter.with_rule(df, model.rules).withColumn("label", (urlfilter.F.col("rule_verdict") == "block").cast("double"))
    weights = {r.url: r.weight for r in urlfilter.sample(labelled, 100, len(urls)).collect()}
    assert weights["http://same.good/"] in (33, 34) and 70 < sum(weights.values()) < 130
    assert sorted(model.judge(df, ["page_id"]).select("page_id").toPandas()["page_id"]) == list(range(1800))
