import datetime as dt
import json

from tidemark.sources import payloads as P


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_repositories(spark):
    page = {"items": [{"full_name": "Own/Repo", "name": "Repo", "owner": {"login": "Own"}, "html_url": "https://github.example/Own/Repo", "stargazers_count": 5, "pushed_at": "2026-01-02T03:04:05Z", "homepage": "", "license": None}, {"name": "x"}]}
    r = P.repositories(frame(spark, json.dumps(page), "broken", None)).collect()
    assert len(r) == 1 and r[0]["external_id"] == "own/repo" and r[0]["rank"] == 1 and r[0]["outbound_urls"] == ["https://github.example/Own/Repo"]
    assert r[0]["published_at"] == dt.datetime(2026, 1, 2, 3, 4, 5)


def test_trending(spark):
    html = '<article><h2><a href="/own/repo"> own / repo</a></h2><p>Fast &amp; small</p><a href="/own/repo/stargazers">1,234</a> 1.2k stars today</article><article>none</article>'
    r = P.trending(frame(spark, html)).collect()
    assert [(x["external_id"], x["summary"], x["stars"], x["stars_today"]) for x in r] == [("own/repo", "Fast & small", 1234, 1200)]


def test_papers(spark):
    xml = '<feed><entry><id>http://arxiv.example/abs/2601.00001v2</id><published>2026-01-01T00:00:00Z</published><title>A\n title</title><summary> s </summary><author><name>Ann</name></author><link href="http://a.example"/><arxiv:primary_category term="cs.X"/></entry></feed>'
    r = P.papers(frame(spark, xml, "<feed/>")).first()
    assert (r["external_id"], r["version"], r["title"], r["author"], r["primary_category"], r["outbound_urls"]) == ("2601.00001", 2, "A title", "Ann", "cs.X", ["http://a.example"])


def test_listings_and_posts(spark):
    listing = {"data": {"children": [{"data": {"id": "a", "title": "t", "selftext": "", "permalink": "/r/x/a", "created_utc": 0, "ups": 3, "num_comments": 2}}, {"data": {"id": "b", "over_18": True}}]}}
    r = P.listings(frame(spark, json.dumps(listing))).collect()
    assert len(r) == 1 and r[0]["engagement"] == 5 and r[0]["summary"] is None and r[0]["source_url"] == "https://reddit.example/r/x/a"
    posts = {"data": [{"id": "1", "author_id": "u", "text": "hi", "public_metrics": {"like_count": 2}}, {"id": "2", "author_id": "gone", "text": "yo"}], "includes": {"users": [{"id": "u", "username": "ann", "verified": True, "public_metrics": {"followers_count": 20000}}]}}
    got = {x["external_id"]: x for x in P.posts(frame(spark, json.dumps(posts))).collect()}
    assert got["1"]["authority"] == 85 and got["1"]["engagement"] == 2 and got["1"]["source_url"] == "https://x.example/ann/status/1"
    assert got["2"]["author"] is None and got["2"]["authority"] == 72


def test_pages(spark):
    html = """<html><head><title>T &amp; U</title><meta name="description" content="About it"><link rel="canonical" href="/c"><meta property="article:published_time" content="2026-01-02T00:00:00Z"></head>
    <body><a href="https://a.example/x">1</a><a href="/y">2</a><a href="z">3</a><a href="#f">4</a><a href="mailto:q">5</a><a href="/y">6</a></body></html>"""
    r = P.pages(spark.createDataFrame([("https://p.example/d/page", html), (None, html)], "url string, html string")).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["title"], r["summary"], r["source_url"]) == ("T & U", "About it", "https://p.example/c")
    assert r["outbound_urls"] == ["https://a.example/x", "https://p.example/y", "https://p.example/d/z"]
    assert r["published_at"] == dt.datetime(2026, 1, 2)
