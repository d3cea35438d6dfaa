"""From page to stored article: extraction layers, cleaning, gates, verdicts, model replies; odd input."""

import json

import pytest
from pyspark.sql import functions as F

from inkstream.functions.pages import Selectors, opengraph, select_fields
from inkstream.operators import analysis, articles, crawl, duplicates, retention, stats, upserts


def page(ld=None, og="", body=""):
    script = f'<script type="application/ld+json">{json.dumps(ld)}</script>' if ld is not None else ""
    return f"<!DOCTYPE html><html><head>{script}{og}</head><body>{body}</body></html>"


ARTICLE = "<article><h1>By hand</h1><time datetime='2025-01-02'>x</time><p>One <b>bold</b> word</p><p> </p><p>Two</article><p>out</p>"
OG = """<meta content='From &quot;graph&quot;' property="og:title"><meta property='og:image' content="i.jpg"/><meta property=og:url content=x><link rel="canonical" href="/c">"""


def test_layers(spark):
    pages = [
        (1, page({"@type": "NewsArticle", "headline": "Data", "articleBody": "&lt;p&gt;A&lt;/p&gt; b", "keywords": "k, l"}, OG, ARTICLE)),
        (2, page({"@type": "Article", "description": "d"}, OG, ARTICLE)),
        (3, page(None, OG, ARTICLE)),
        (4, page(None, OG, "<p>no article</p>")),
        (5, page(None, "", "")),
        (6, None),
        (7, ""),
        (8, page({"@type": "Article", "articleBody": " &lt;br&gt; "}, "", ARTICLE)),
    ]
    got = {r.id: r for r in articles.extract_articles(spark.createDataFrame(pages, "id int, page string"), "id", "page").collect()}
    assert [(got[i].extraction_method, got[i].extraction_confidence) for i in range(1, 9)] == [
        ("json_ld", 0.95), ("selectors", 0.85), ("selectors", 0.75), ("opengraph", 0.3), ("opengraph", 0.0), ("opengraph", 0.0), ("opengraph", 0.0), ("selectors", 0.85),
    ]
    a, b, c = got[1], got[2], got[3]
    assert (a.title, a.body, a.tags, a.image_urls, a.published_at) == ("Data", "A b", ["k", "l"], ["i.jpg"], "2025-01-02")
    assert (b.title, b.body, b.summary) == ('From "graph"', "One bold word\n\nTwo", "d")
    assert c.canonical_url == "/c" and got[8].title == "By hand" and got[6].tags == [] and got[5].title is None


def test_selectors():
    s = Selectors(title=("h2.none::text", "div#t h2::text"), author=(".by a[rel]::text",), images=("img::attr(src)",), tags=("ul.tags li::text",), body=("div.story p::text", "article p::text"))
    html = '<div id=t><h2>T &amp; <i>U</i></h2></div><p class="x by"><a rel=author>N</a><img src=1><img src=2></p><ul class=tags><li>a<li>b</ul>' + ARTICLE
    got = select_fields(html, s)
    assert (got["title"], got["author"], got["image_urls"], got["tags"], got["body"]) == ("T & U", "N", ["1", "2"], ["a", "b"], "One bold word\n\nTwo")
    assert select_fields(None, s)["title"] is None and select_fields("<p>" + "x " * 200_000, s)["tags"] == []
    with pytest.raises(ValueError):
        select_fields("", Selectors(title=("h1:first-child::text",)))


def test_opengraph_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, '<META NAME=x CONTENT="a > b" PROPERTY="og:title">'), (4, "<meta property='og:title' content=''><meta property='og:title' content='second'>")]
    got = {r.id: r.x for r in spark.createDataFrame(rows, "id int, p string").select("id", opengraph(F.col("p")).alias("x")).collect()}
    assert [got[i].title for i in (1, 2, 3)] == [None, None, "a > b"]


CLEAN = "id int, title string, subtitle string, author string, category string, summary string, body string, published_at string, updated_at string, image_urls array<string>, tags array<string>, extraction_method string, extraction_confidence double, reason string"


def test_clean_extracted(spark):
    long = "A line of text.\n\n  Another  line. " * 10
    rows = [
        (1, " A  title ", "", None, " c ", "s", long, "2025", None, ["a", None, ""] * 30, ["t  x"] * 60, None, None, "clash"),
        (2, "Abc", None, None, None, None, long, None, None, None, None, "json_ld", 0.9, None),
        (3, "A title", None, None, None, None, "short", None, None, None, None, None, None, None),
        (4, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (None, "A title", None, None, None, None, "x" * 300_000, None, None, None, None, None, None, None),
    ]
    good, bad = articles.clean_extracted(spark.createDataFrame(rows, CLEAN), "id")
    got = {r.id: r for r in good.collect()}
    assert set(got) == {1, None} and {(r.id, r.reason) for r in bad.collect()} == {(2, "title too short"), (3, "body too short"), (4, "title too short")}
    a = got[1]
    assert (a.title, a.subtitle, a.category, a.language, len(a.image_urls), len(a.tags), a.tags[0]) == ("A title", None, "c", "en", 20, 50, "t x")
    assert a.body.startswith("A line of text.\n\nAnother line.") and a.word_count == 60 and a.extraction_method == "selectors"
    assert articles.clean_extracted(spark.createDataFrame([], CLEAN), "id")[0].count() == 0


def test_gate(spark):
    rows = [(1, "t", "b", True, "l"), (2, "", "b", True, "l"), (3, "t", None, True, None), (4, "t", "b", False, None), (5, "t", "b", True, ""), (6, "t", "b", None, "l")]
    got = articles.crawl_gate(spark.createDataFrame(rows, "id int, title string, body string, changed boolean, loc string"), F.col("changed"), "loc")
    assert [r.gate for r in got.orderBy("id").collect()] == ["pass", "no_content", "no_content", "unchanged", "no_location", "unchanged"]


def test_verdicts(spark):
    schema = "article_id long, canonical_url string, content_hash string, simhash long"
    old = [(1, "u1", "h1", 0b1111), (2, "u1", "h2", 5), (3, None, "h3", 0), (4, None, None, None), (5, "u5", "h1", 0b1110)]
    new = [(11, "u1", "h1", 9), (12, "u1", "hx", 9), (13, "n", "h3", 9), (14, "n", "hy", 0b1000), (15, "n", "hz", -1), (16, None, None, None), (17, None, None, 0), (18, "n", "hq", 0b1000)]
    frames = [spark.createDataFrame(x, schema) for x in (new, old)]
    got = {r.article_id: (r.verdict, r.other) for r in articles.persist_verdicts(*frames).collect()}
    assert got == {11: ("unchanged", 1), 12: ("updated", 1), 13: ("duplicate_exact", 3), 14: ("duplicate_near", 5), 15: ("created", None), 16: ("created", None), 17: ("created", None), 18: ("duplicate_near", 5)}
    assert articles.persist_verdicts(frames[0], frames[1].limit(0)).where("verdict <> 'created'").count() == 0


def test_longer_keys_find_the_same_pairs(spark):
    import random

    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for bits in (1, 2, 3, 4, 5, 6):
            x = v
            for k in r.sample(range(64), bits):
                x ^= 1 << k
            values.append(x)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, f long")
    apart = lambda a, b: bin(values[a] ^ values[b]).count("1")
    band = lambda a, b: any((values[a] >> (16 * k)) & 65535 == (values[b] >> (16 * k)) & 65535 for k in range(4))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))]
    assert {(x.a, x.b) for x in duplicates.banded_pairs(df, "id", "f", 3).collect()} == {p for p in pairs if apart(*p) <= 3}
    assert {(x.a, x.b) for x in duplicates.gray_pairs(df, "id", "f").collect()} == {p for p in pairs if 4 <= apart(*p) <= 6 and band(*p)}


def test_replies(spark):
    full = {"summary": "A summary of it.", "topics": [" a ", "", None] + ["t"] * 20, "entities": [{"entity": "Dhaka", "type": " Location "}], "sentiment": " POSITIVE", "keywords": ["k"] * 20}
    rows = [
        json.dumps(full), "```json\n" + json.dumps({**full, "entities": {"Dhaka": "location", "Board": "A. Person"}, "sentiment": None}) + "\n```", "nothing", None, '{"summary": "short"}',
        json.dumps({**full, "sentiment": "angry"}), json.dumps({**full, "entities": [{"name": "", "type": "person"}]}), json.dumps({**full, "entities": [{"name": "x", "type": "animal"}]}), '{"summary": "A summary of it.", "topics": "no list"}', "{broken",
    ]
    got = analysis.validate_analyses(spark.createDataFrame(list(enumerate(rows)), "id int, reply string"), "reply")
    got = {r.id: r for r in got.collect()}
    assert [got[i].reason for i in range(10)] == [None, None, "no object", "no object", "summary", "sentiment", "entities", "entities", None, "no object"]
    a = got[0].analysis
    assert (a.sentiment, a.topics[:2], len(a.topics), len(a.keywords), [tuple(e) for e in a.entities]) == ("positive", ["a", "t"], 10, 15, [("Dhaka", "location")])
    assert got[1].analysis.sentiment == "neutral" and {tuple(e) for e in got[1].analysis.entities} == {("Dhaka", "location"), ("A. Person", "other")}
    assert got[8].analysis.topics == [] and got[2].analysis is None


def test_failures_and_blocked(spark):
    rows = [(200, None, None), (403, None, "http_403"), (429, "x", "http_429"), (503, None, "http_5xx"), (404, None, "http_other"), (None, "TimeoutError", "connection_timeout"), (None, "DNSLookupError", "dns_failure"), (None, "playwright Error", "browser_failure"), (None, "IgnoreRequest robots", "robots_restricted"), (None, "boom", "unknown"), (None, None, None)]
    got = spark.createDataFrame(rows, "s int, e string, want string").select("want", crawl.failure_category(F.col("s"), F.col("e")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    rows = [("image", "u", True), ("document", "https://x.doubleclick.net/a", True), ("document", "https://news", False), (None, None, False)]
    assert all(r.want == r.got for r in spark.createDataFrame(rows, "k string, u string, want boolean").select("want", crawl.blocked(F.col("k"), F.col("u")).alias("got")).collect())


def test_fold_attempts(spark):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    rows = [(1, 1, "success", t), (2, 1, "failed", t + timedelta(seconds=5)), (3, 1, "failed", t + timedelta(seconds=9)), (3, 1, "failed", t + timedelta(seconds=9)), (4, 2, "success", t), (5, 3, None, t), (6, None, "success", t), (7, 4, "success", None)]
    got = {r.url_id: r for r in crawl.fold_attempts(spark.createDataFrame(rows, "id long, url_id long, outcome string, attempted_at timestamp"), F.lit(True)).collect()}
    assert {k: (r.attempts, r.last_outcome, r.failures, r.due_s - r.last_s) for k, r in got.items()} == {1: (3, "failed", 2, 120), 2: (1, "success", 0, 1800), 3: (1, None, 1, 60)}


def test_retention(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"2025-01-{1 + i % 5:02d}") for i in range(1, 40)], "id long, day string").withColumn("at", F.col("day").cast("timestamp"))
    got = [tuple(r) for r in retention.purge_batches(df, "id", "at", F.lit("2025-01-04").cast("timestamp"), size=4, most=5).orderBy("batch", "at", "id").select("id", "batch").collect()]
    old = sorted(((i % 5, i) for i in range(1, 40) if i != 3 and i % 5 < 3))[:20]
    assert got == [(i, k // 4 + 1) for k, (_, i) in enumerate(old)]
    rows = [("s3://b/k/1",), ("https://host/b2/k2?x",), ("/bare/key",), (" ",), (None,), ("ftp://x/y",), ("s3://b/k/1",)]
    blobs = spark.createDataFrame(rows, "l string").select(retention.blob_address(F.col("l"), "own").alias("x")).select("x.*")
    assert {tuple(r) for r in retention.delete_chunks(blobs, 1).collect()} == {("b", "k/1", 1), ("b2", "k2", 1), ("own", "bare/key", 1)}
    assert (retention.interval_seconds(0.5), retention.interval_seconds(10), retention.interval_seconds(None, 2), retention.interval_seconds(None)) == (60.0, 600, 7200, 60.0)
    with pytest.raises(ValueError):
        retention.recent(df, "at", "id", 500)


def test_sources(spark):
    s = spark.createDataFrame([("a", "http://a", True, False), ("b", "http://b", True, True)], "slug string, base_url string, enabled boolean, crawl_enabled boolean")
    assert [r.slug for r in crawl.sources_to_crawl(s).collect()] == ["b"] and [r.slug for r in crawl.sources_to_crawl(s, "a").collect()] == ["a"]
    new = spark.createDataFrame([("c", "https://c//"), ("c", "https://d"), ("a", "http://x"), ("Bad", "http://x"), ("e", "ftp://x"), (None, None)], "slug string, base_url string")
    rows, verdicts = crawl.insert_sources(s, new)
    assert {r.slug: r.verdict for r in verdicts.collect()} == {"c": "inserted", "a": "conflict", "Bad": "invalid", "e": "invalid", None: "invalid"}
    assert [r.base_url for r in rows.where("slug = 'c'").collect()] == ["https://c"] and rows.count() == 3
    patched = crawl.patch(s, spark.createDataFrame([("a", None, False)], "slug string, base_url string, enabled boolean"), "slug")
    assert sorted(map(tuple, patched.collect())) == [("a", "http://a", False, False), ("b", "http://b", True, True)]


def test_gauges(spark):
    cells = spark.createDataFrame([("a", 10, 0), ("a", 20, 8), ("a", 40, 10), ("b", 10, 0), ("b", 20, 0), ("b", 40, 0)], "k string, le int, n long")
    assert {r.k: r.quantile for r in stats.histogram_quantile(cells, "k", 0.5).collect()} == {"a": 16.25, "b": None}
    assert {r.k: r.n for r in stats.zero_filled(cells.where("n = 8").select("k", "n"), "k", "n", ["a", "z"]).collect()} == {"a": 8, "z": 0}
    m = spark.createDataFrame([("up", {"b": 'q"\\', "a": "x\ny"}, 1.5), ("up", {}, 2.0), ("none", None, None)], "name string, labels map<string,string>, value double")
    assert sorted(r.line for r in stats.exposition(m).collect()) == ["up 2.0", 'up{a="x\\ny",b="q\\"\\\\"} 1.5']
    state = spark.createDataFrame([("j", "ok", 1)], "job string, name string, n long")
    assert [tuple(r) for r in upserts.add_named_counters(state, state.withColumn("n", F.lit(2).cast("long")), ["job"], "name", "n", ["ok"]).collect()] == [("j", "ok", 3)]
    with pytest.raises(Exception, match="unknown counter: bad"):
        upserts.add_named_counters(state, state.withColumn("name", F.lit("bad")), ["job"], "name", "n", ["ok"]).collect()


def test_url_form(spark):
    from inkstream.functions.vectorised import UrlForm
    from inkstream.operators.frontier import bucket_ttl, budget

    f = UrlForm.from_dict({"keep_params": ["id"], "unknown": 1})
    df = spark.createDataFrame([("https://x.y/a/", "../b?id=1&z=2"), (None, "nonsense"), ("https://x.y", None)], "base string, url string")
    assert [r[0] for r in df.select(f.udf()("base", "url")).collect()] == ["https://x.y/b?id=1", None, "https://x.y/"]
    assert UrlForm.from_dict(None) == UrlForm()
    assert (budget(20, None, 500), budget(20, 30, 25), budget(20, 30, 40), bucket_ttl(0.5, 2.0)) == (20, 5, 0, 64)


def test_token_bucket_runs_over_spans(spark):
    """Against a fold over each key's rows; spans shorter than the runs, so that runs reach over many of them."""
    import random

    from inkstream.operators.frontier import token_bucket

    r = random.Random(2)
    rows, i = [], 0
    for k in range(3):
        t = 0
        for _ in range(150):
            t += r.choice([0, 300_000, 1_000_000, 2_500_000, 9_000_000])
            rows.append((k, i, t))
            i += 1
    want, tokens, last, here = {}, 0, 0, None
    for k, i, t in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        tokens, here = (2.0, k) if here != k else (min(2.0, tokens + (t - last) / 1e6 * 0.5), k)
        last = t
        want[i] = (tokens >= 1, 0.0 if tokens >= 1 else (1 - tokens) / 0.5)
        tokens -= tokens >= 1
    df = spark.createDataFrame(rows + [(None, 9000, 1), (1, 9001, None)], "k int, i int, us long")
    for span in (1, 7, 86_400):
        got = {x.i: (x.allowed, x.wait_s) for x in token_bucket(df, "k", "i", "us", 0.5, 2.0, span_s=span).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
