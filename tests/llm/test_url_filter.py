from __future__ import annotations

from tidewater.llm.url_filter import RULES, judge_urls


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(r), v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else None


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = judge_urls(pages)
    assert out.count() == pages.count()
    for r in out.collect():
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_aliases(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<META content="0; URL={}" http-equiv=refresh>'
    rows = [
        (1, "http://a.net/x", canonical.format("https://shop.com/de/1")),
        (2, "http://A.net/x#part", None),
        (3, "http://b.net/y", refresh.format("http://c.org/")),
        (4, "http://c.org/", canonical.format("http://d.net/")),
        (5, "http://d.net", ""),
        (6, None, canonical.format("http://shop.com/de/")),
        (7, "no url", "<link rel=canonical href='/q'>"),
        (8, "http://e.net/a/b.html?q=1", "<link href='../../x' rel='stylesheet'><link rel=canonical href='//shop.com/de/2'>"),
        (9, "http://f.net", "<link rel=canonical href='http://c.org/'><link rel=canonical href='http://shop.com/de/9'>"),
        (10, "http://g.net/1", canonical.format("http://g.net/2")),
        (11, "http://www.shop.com/de/5", canonical.format("http://h.net/")),
        (12, "http://h.net", None),
        (12, "http://h.net", None),
        (13, "http://xorg/es", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id int, url string, html string, rule string, _node int")
    out = judge_urls(df)
    assert out.count() == len(rows)
    verdicts = {r.page_id: r.verdict for r in out.collect()}
    assert sorted(k for k, v in verdicts.items() if v == "block") == [1, 2, 8, 11, 12]
    assert judge_urls(df.limit(0)).count() == 0


def test_given_edges_and_hot_hub(spark):
    pages = spark.createDataFrame([(k, f"http://s{k % 400}.net/") for k in range(1200)], "page_id int, url string").withColumnRenamed("page_id", "page_id")
    edges = spark.createDataFrame([(f"http://s{k}.net/", "http://bad.com/de/") for k in range(0, 400, 2)], "u string, v string")
    out = judge_urls(pages, edges=edges)
    assert out.filter("verdict = 'block'").count() == 600 and out.count() == 1200
