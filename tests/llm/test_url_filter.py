import re

from modelscout.llm import url_filter as U


def brute(url, listed, rules=U.RULES):
    host = path = ""
    key = None
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
        path = m[2]
        key = re.sub(r"^www\.", "", host) + path.rstrip("/")
    fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2], key in listed
    return host, path, None, "block" if key in listed else "allow", key in listed


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net/fr/1", "http://net", "http://net/", "http://internet/", "ftp://x.org/fr/", "https://org/frx",
    "http://example.com/de/", "http://sub.example.com/de", "http://www.site.test/a/", "https://site.test/a#q", "http://site.test/b", "x://y://z.net/en/", "http://ÄB.Net/é", "http://h?://q/",
    "http://line\nbreak.net/a\nb?c", "http://long.test/" + "a" * 50_000,
]


def test_matches_brute_force(make):
    rows = [(i, u, "x", 0) for i, u in enumerate(URLS)] + [(3, URLS[3], "x", 0), (None, URLS[14], None, None)]
    pages = make(rows, "page_id bigint, url string, block string, bits int")
    listed = {"site.test/a", "never.seen/1", "long.test/" + "a" * 50_000}
    urls = make([(u, 1) for u in [*listed, "site.test/a", None]], "url string, page_id int")
    for most in (1, 1000):
        got = U.url_verdicts(pages, urls, max_blocks=most).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *brute(u, listed))) for i, u, *_ in rows)


def test_filter_turns_away_what_is_not_listed(make, spark):
    listed = make([(f"a{i}.test/{i}",) for i in range(1000)], "url string")
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://b', id, '.test/', id) AS url")
    bloom = U.bloom_blocks(listed, 32)
    assert bloom.count() <= 32 and all(len(r["bits"]) == U.WORDS for r in bloom.collect())
    assert U.url_verdicts(pages, listed).filter("verdict = 'block'").count() == 0


def test_empty(make):
    pages = make([(1, "http://a.b/c")], "page_id bigint, url string")
    none = make([], "url string")
    assert [tuple(r) for r in U.url_verdicts(pages, none).collect()] == [(1, "a.b", "/c", None, "allow", False)]
    assert U.url_verdicts(pages.limit(0), none).collect() == []
