from foliospark.llm import urls
from foliospark.llm.queries import URL_RULES


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fits, key=lambda r: len(r[1] + r[2]), default=None)


URLS = [
    "http://a.example.net/en/1", "https://A.Example.NET/de/1#x", "http://example.com/de/", "http://x.example.com/fr/", "http://b.org/fr/2?x=/y",
    "http://b.net", "http://b.net?x", "http://notnet/", "http://net/", "no scheme", None, "", "x://y://z/de/", "http://É.example.com/de/1", "http://m.example.com\n/de/",
]


def judged(spark, pages):
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, host string, path int, rule string, verdict string, node string")
    return {r.page_id: r for r in urls.judge(rows, URL_RULES, urls.page_links(rows)).collect()}


def test_rules_of_single_urls(spark):
    found = judged(spark, [(i, u, None, "old", 1, "old", "old", "n") for i, u in enumerate(URLS)])
    for i, u in enumerate(URLS):
        host, path, rule = plain_rule(u)
        assert (found[i].host, found[i].path) == (host, path), u
        assert found[i].rule == (rule and rule[1] + rule[2]), u
        assert found[i].verdict == (rule[0] if rule else "allow"), u


def test_blocks_spread_over_links_and_allows_go_first(spark):
    def page(i, url, html):
        return (i, url, html, None, None, None, None, None)

    found = judged(spark, [
        page(0, "http://m.site.org/en/a", '<LINK href="https://site.net/a" data-x=">" rel=canonical>'),
        page(1, "http://site.org/en/b", "<meta http-equiv='Refresh' content='0; URL=http://m.site.org/en/a'>"),
        page(2, "http://site.org/en/c", "<p>canonical</p>"),
        page(3, "http://x.example.net/en/d", "<link rel='canonical' href='//y.net/d'>"),
        page(4, "http://y.org/en/d", "<link rel='x canonical' href='http://y.net/d?a=1&amp;b=2'/>"),
        page(5, "http://z.org/en/d", "<link rel='canonical' href='//y.net/d'>"),
        page(6, "http://q.com/p", "<link rel='canonical' href='/other#frag'>"),
        page(7, "http://q.com/other", None),
        page(8, "http://loop.com/1", "<link rel=canonical href=http://loop.com/1>"),
        page(9, None, "<link rel=canonical href=http://loop.net/1>"),
    ])
    verdicts = {i: r.verdict for i, r in found.items()}
    assert verdicts == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    assert found[3].rule == "example.net/en/" and found[0].rule is None


def test_no_pages(spark):
    assert judged(spark, []) == {}
