import pytest

from lodestrata.llm import urls
from lodestrata.llm.queries import op3_urls


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled(spark))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_judge(spark, model):
    cases = [
        None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/1234", "http://xexample.org/en/1", "https://a.com/de/x?y#z", "http://a.com/fr/", "http://com/de/",
        "http://org", "http://org?x/", "http://É.org/é#://", "a://b://c.org/x", "http://cheap-pills.example.net/en/4", "http://river-museum.net/en/4", "x\ny://h.com\n/fr/", "http://h.net/" + "ab" * 50_000,
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").selectExpr("*", "'?' as host", "'?' as verdict")
    got = {r.page_id: r for r in urls.judge(df, model).collect()}
    for k, url in enumerate(cases):
        r = got[k]
        assert (r.host, r.path) == parts(url), url
        name, verdict = rule(r.host, r.path)
        assert r.rule == name, url
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert got[15].verdict == "block" and got[16].verdict == "allow"
    assert urls.judge(df.where("false"), model).collect() == []


def test_unseen_words(spark, model):
    bad = [f"http://{a}{b}.example.net/en/{k}" for k, (a, b) in enumerate(zip(urls.BAD, urls.BAD[7:], strict=False))]
    good = [f"http://{a}{b}.example.net/en/{k}" for k, (a, b) in enumerate(zip(urls.GOOD, urls.GOOD[7:], strict=False))]
    seen = {u.split("/")[2] for u, _ in urls.samples()}
    df = spark.createDataFrame([(u, 1) for u in bad] + [(u, 0) for u in good], "url string, bad int")
    got = [r for r in urls.judge(df, model, rules=()).collect() if r.host not in seen]
    assert len(got) > 30
    assert sum((r.verdict == "block") == bool(r.bad) for r in got) >= 0.9 * len(got)


def test_query(spark, tiny):
    df = op3_urls(spark, tiny)
    got = df.collect()
    want = {r.page_id: r.url for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(want)
    for r in got:
        assert (r.host, r.path) == parts(want[r.page_id])
        assert (r.rule, r.verdict if r.rule else None) == rule(r.host, r.path)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
