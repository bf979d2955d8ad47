import re

from check_oracles import compare, connect

from phasegrid.llm import urls
from phasegrid.llm.queries import ORACLE, QUERIES


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(s + p), s + p, v) for s, p, v in urls.RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


CASES = [
    None, "", "no address", "http://", "http://org", "http://org/", "HTTP://Sub.EXAMPLE.org/es/1?x#y", "http://example.org/en/1",
    "http://example.org/en/2", "http://badexample.org/es/", "https://a.com/fr/x", "https://a.com/de/", "https://a.net?x=/fr/", "x://y://z/w",
    "http://www.bad.net/a/", "http://bad.net/a", "http://bad.net/b", "http://ÄÖ.net/a\nb", "http://www.bad.net/a/",
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(CASES)], "page_id long, url string, block int, rule int")
    listed = spark.createDataFrame([("bad.net/a",), ("bad.net/a",), (None,), ("",)], "url string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, listed).collect()}
    assert len(got) == len(CASES)
    for i, url in enumerate(CASES):
        host, path, rule, verdict = plain(url)
        expected = verdict or ("block" if re.fullmatch(r"http://(www\.)?bad.net/a/?", url or "") else "allow")
        assert tuple(got[i])[1:5] == (host, path, rule, expected), url


def test_full_filter_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BLOCKS", 1)
    pages = spark.createDataFrame([(i, f"http://h.net/{i}") for i in range(5000)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h.net/{i}",) for i in range(0, 5000, 7)], "url string")
    got = urls.filter_urls(pages, listed).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(0, 5000, 7))
    assert sum(r["maybe_listed"] for r in got) > 4000


def test_filter_lets_few_through(spark):
    pages = spark.createDataFrame([(i, f"http://h.net/{i}") for i in range(20000)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h.net/{i}",) for i in range(0, 20000, 10)], "url string")
    got = urls.filter_urls(pages, listed).collect()
    assert sum(r["is_listed"] for r in got) == 2000 and sum(r["maybe_listed"] for r in got) < 2100


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages, urls.listed_sites(pages)).count() == 0


def test_oracle(spark, data):
    got = QUERIES["op3_url_filter"](spark, data).toPandas()
    assert compare(got, connect(data).execute(ORACLE["op3_url_filter"]).df()).startswith("ok")


CONTRACT_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def test_rules_are_the_contracts(spark):
    assert tuple(urls.RULES) == CONTRACT_RULES
    for site, start, said in CONTRACT_RULES:
        assert f"('{site}', '{start}', '{said}')" in ORACLE["op3_url_filter"]
    pages = spark.createDataFrame([(0, "http://example.org/en/1"), (1, "http://a.example.org/en/12?q"), (2, "http://example.org/en/2")],
                                  "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, urls.listed_sites(pages)).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow")}
