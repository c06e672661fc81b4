import json
from datetime import UTC, datetime
from email.message import Message
from io import BytesIO
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from siftwell.cli import main
from siftwell.operators.store import Table
from siftwell.session import scratch_path
from siftwell.sinks import documents
from siftwell.sources import config, feeds, http, listings, ranked
from siftwell.streaming import ingest

SOURCES = [{"id": "s", "name": "S", "tier": 1, "type": "official", "tags": ["t"], "allowed_domains": ["e.com"], "max_items": 2, "community_rank_limit": 2, "community_min_points": 10, "community_min_comments": 5}]
RSS = b"""<rss><channel><item><title>A &amp;amp; <![CDATA[<b>B</b>]]></title><link>https://www.e.com/a/?utm_source=x</link><guid>g1</guid><pubDate>Thu, 09 Jan 2025 00:06:07 GMT</pubDate>
<description><![CDATA[<p>Body</p>]]></description><category>x</category><category>x</category></item><item><title>no link</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="urn:o"><o:totalResults>7</o:totalResults><entry><id>http://x.org/abs/2501.00001v2</id><title>Paper</title><published>2025-01-09T00:00:00Z</published><updated>2025-01-09T00:00:00Z</updated>
<summary>See https://github.com/a/b.</summary><author><name>N. One</name></author><link rel="related" type="application/pdf" href="http://x.org/pdf/2501.00001v2"/><link href="http://x.org/abs/2501.00001v2"/><category term="cs.A"/></entry>
<entry><id>http://x.org/abs/2501.00002v1</id><title>Undated</title></entry></feed>"""


@pytest.fixture
def sources(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps(SOURCES))
    return config.load_sources(spark, path)


def test_feeds(spark, sources):
    raw = feeds.raw_entries(spark.createDataFrame([("s", bytearray(RSS)), ("s", bytearray(b"<broken")), ("s", None)], "source_id string, payload binary"))
    (r,) = feeds.records(raw, sources, F.lit(datetime(2025, 2, 1))).collect()
    assert (r["title"], r["canonical_url"], r["summary"], r["categories"], r["published_at_verified"], r["external_id"], r["tags"]) == ("A & B", "https://e.com/a", "Body", ["x"], True, "g1", ["t"])
    assert [f["source_id"] for f in feeds.failures(raw).collect()] == ["s"]
    raw = feeds.raw_entries(spark.createDataFrame([("s", bytearray(ATOM))], "source_id string, payload binary"))
    (p,) = feeds.paper_records(raw, F.lit(datetime(2025, 2, 1))).collect()
    assert (p["external_id"], p["version"], p["version_type"], p["code_url"], p["authors"], p["total"], p["pdf_url"]) == ("2501.00001", 2, "initial-version", "https://github.com/a/b", ["N. One"], 7, "http://x.org/pdf/2501.00001v2")


def test_posts(spark, sources):
    post = {"id": 1, "status": "publish", "link": "https://e.com/p", "date_gmt": "2025-01-09T00:00:00", "title": {"rendered": "T"}, "content": {"rendered": "<p>B</p>", "protected": False}}
    bad = [post | {"link": "http://e.com/p"}, post | {"link": "https://evil.com/p"}, post | {"date_gmt": ""}, post | {"status": "draft"}, post | {"content": {"rendered": "B", "protected": True}}]
    for k, b in enumerate(bad):
        page = spark.createDataFrame([("s", bytearray(json.dumps([b, post, post | {"id": 3}]).encode()))], "source_id string, payload binary")
        assert [(r["external_id"], r["summary"]) for r in feeds.posts(page, sources).collect()] == [("1", "B")], k


def test_stories(spark, sources):
    lists = spark.createDataFrame([("s", bytearray(b"[11, 12, 13]"))], "source_id string, payload binary")
    order = ranked.ranks(lists, 3)
    details = [{"id": 11, "type": "story", "time": 1736380800, "title": "One", "score": 12, "descendants": 0}, {"id": 12, "type": "job", "time": 1, "title": "x"}, {"id": 13, "type": "story", "time": 1736380800, "title": "Three", "url": "https://e.com/3", "score": 99}]
    got = {r["rank"]: r for r in ranked.stories(order, spark.createDataFrame([(d["id"], json.dumps(d)) for d in details], "id long, payload string"), sources).collect()}
    assert set(got) == {1, 3} and got[1]["qualified"] and not got[3]["qualified"] and got[1]["url"] == got[1]["discussion_url"] and got[3]["url"] == "https://e.com/3"


def test_articles(spark, sources):
    page = b'<html><meta property="og:title" content="M"><meta property="article:published_time" content="2025-01-01T00:00:00Z"><script type="application/ld+json">{"@type":"BlogPosting","headline":"H","datePublished":"2025-01-09T00:00:00Z","author":{"name":"N"}}</script></html>'
    pages = [page, page.replace(b"BlogPosting", b"Thing"), None, b"<meta content='D &amp; E' name=description>" + page.replace(b'{"@type"', b'[{"@type":"Person"},{"@type"').replace(b"}}<", b"}}]<"), page.replace(b"}}<", b"<")]
    said = [tuple(r["a"]) for r in spark.createDataFrame([(k, None if p is None else bytearray(p)) for k, p in enumerate(pages)], "k int, payload binary").select("k", ranked.article_meta(F.col("payload")).alias("a")).orderBy("k").collect()]
    post = ("2025-01-09T00:00:00Z", "H", "", "N")
    assert said == [post, ("", "M", "", ""), ("", "", "", ""), post, ("", "M", "", "")]  # without a BlogPosting, or one that can't be read, there is no date
    entries = spark.createDataFrame([("s", "7", 1, "", 3, 4), ("s", "8", 2, "T", 3, 4)], "source_id string, id string, rank int, title string, points int, comments int")
    pages = spark.createDataFrame([("7", "https://e.com/post/7", bytearray(page)), ("8", "https://e.com/post/9", bytearray(page))], "id string, final_url string, payload binary")
    (r,) = ranked.ranked_articles(entries, pages, sources).collect()
    assert (r["id"], r["title"], r["author"], r["rank"]) == ("7", "H", "N", 1)


def entry(i, title="T", cross="", primary="cs.A"):
    return f'<dt><a href="/abs/{i}v1" title="Abstract">arXiv:{i}</a> {cross}</dt><dd><div class="list-title"><span>Title:</span> {title}</div><div class="list-authors"><a href="#">N. One</a>, <a>M. Two</a></div><div class="list-comments">Comments: c</div><div class="list-subjects"><span class="primary-subject">Area ({primary})</span>; Other (cs.B)</div><p class="mathjax">Sum</p></dd>'


def new_page(*sections, total):
    return f'<h3>Showing new listings for Friday, 9 January 2026</h3><div class="paging">Total of {total} entries</div>' + "".join(f'<dl id="articles"><h3>{name} (showing {n} of {n} entries)</h3>{"".join(es)}</dl>' for name, n, es in sections)


def test_listings(spark):
    a = new_page(("New submissions", 1, [entry("2601.00001")]), ("Cross submissions", 2, [entry("2601.00002", primary="cs.V"), entry("2501.00003", primary="cs.V")]), total=3)
    v = new_page(("New submissions", 1, [entry("2601.00002", primary="cs.V")]), total=1)
    short = new_page(("New submissions", 2, [entry("2601.00009")]), total=2)
    rows = listings.listed(spark.createDataFrame([("a", "cs.A", bytearray(a.encode())), ("v", "cs.V", bytearray(v.encode()))], "page_id string, category string, payload binary"))
    r = {(x["page_id"], x["identifier"]): x for x in rows.collect()}
    one = r["a", "2601.00001"]
    assert (one["section"], one["title"], one["summary"], one["authors"], one["categories"], one["primary"], one["comment"], one["total"], str(one["day"])) == ("new", "T", "Sum", ["N. One", "M. Two"], ["cs.A", "cs.B"], "cs.A", "c", 3, "2026-01-09")
    accepted, excluded = listings.announced(rows)
    assert {x["identifier"] for x in accepted.collect()} == {"2601.00001", "2601.00002"} and {x["identifier"] for x in excluded.collect()} == {"2501.00003"}
    assert listings.section_faults(rows).count() == 0 and listings.row_faults(rows).count() == 0
    bad = listings.listed(spark.createDataFrame([("x", "cs.A", bytearray(short.replace("arXiv:2601.00009", "arXiv:2601.00008").encode()))], "page_id string, category string, payload binary"))
    assert listings.section_faults(bad).count() == 1 and listings.row_faults(bad).count() == 1


def test_recent_listing():
    page = '<div class="paging">Total of 3 entries</div><dl id="articles"><h3>Fri, 9 Jan 2026 (showing 2 of 2 entries )</h3>' + entry("2601.00001") + entry("2601.00002", cross="(cross-list from cs.V)", primary="cs.V") + "<h3>Thu, 8 Jan 2026</h3><p>No updates for this time period.</p></dl>"
    total, rows = listings.listing(page.encode())
    assert total == 3 and [(str(r["day"]), r["section"], r["cross_from"], r["section_shown"]) for r in rows] == [("2026-01-09", "new", None, 2), ("2026-01-09", "cross", "cs.V", 2)]


def test_config(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"news_hours": 24, "unknown": 1}))
    assert config.load_settings(path, {"SIFTWELL_SIMILARITY": "0.5"}) == config.Settings(news_hours=24, similarity=0.5)
    path.write_text(json.dumps([{"id": "a"}, {"id": "a"}]))
    with pytest.raises(ValueError, match="a"):
        config.load_sources(spark, path)
    assert config.reader("rss") is feeds.raw_entries
    with pytest.raises(ValueError):
        config.reader("none")


class Answer(BytesIO):
    status, headers = 200, Message()

    def geturl(self):
        return "https://e.com/final"


def failing(*codes, after=None):
    left = list(codes)

    def open_url(request, timeout):
        if left:
            h = Message()
            if after:
                h["Retry-After"] = after
            raise HTTPError(request.full_url, left.pop(0), "x", h, None)
        return Answer(b"ok")

    return open_url


def test_policy():
    p, step = http.Policy(retries=2, first_wait=3, first_wait_when_limited=30), http.Step
    assert [http.next_step(p, k, 429) for k in range(3)] == [step("again", 30), step("again", 60), step("give up")]
    assert [http.next_step(p, k, None) for k in range(3)] == [step("again", 3), step("again", 6), step("give up")]
    assert http.next_step(p, 0, 404) == step("give up") and http.next_step(p, 0, 503, 45) == step("again", 45) and http.next_step(p, 0, 503, 900) == step("put off", 900)
    now = datetime(2025, 1, 9, tzinfo=UTC)
    assert [http.requested_wait(v, now) for v in ("45", "Thu, 09 Jan 2025 00:01:00 GMT", "Thu, 09 Jan 2020 00:01:00 GMT", "x", None)] == [45, 60, 0, 0, 0]


def test_http():
    waits = []
    page = http.fetch("https://e.com", "a", http.Policy(first_wait=3, first_wait_when_limited=30), sleep=waits.append, open_url=failing(429, 429))
    assert (page["payload"], page["final_url"], waits) == (b"ok", "https://e.com/final", [30, 60])
    waits.clear()
    http.fetch("https://e.com", "a", sleep=waits.append, open_url=failing(503, after="45"))
    assert waits == [45]
    with pytest.raises(http.PutOff):
        http.fetch("https://e.com", "a", sleep=waits.append, open_url=failing(429, after="900"))
    with pytest.raises(HTTPError):
        http.fetch("https://e.com", "a", sleep=waits.append, open_url=failing(404))


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "news", "A [x]", "https://e.com/?a=1&b=2", "2025-01-02", True, "S & T", 2.0), (2, "paper", "B", "u", "2025-01-03", False, None, 1.0)], "id long, kind string, title string, url string, published_at string, is_important boolean, summary string, score double")
    made = documents.export([df], tmp_path / "out", datetime(2025, 2, 1, tzinfo=UTC))
    doc = json.loads(made[0].read_text())
    assert doc["count"] == 2 and [i["id"] for i in doc["items"]] == [2, 1] and "A \\[x\\]" in made[1].read_text() and "a=1&amp;b=2" in made[2].read_text()
    assert "Nothing." in documents.markdown([], datetime(2025, 2, 1, tzinfo=UTC))
    assert documents.archive("{}", "2025-01-02", tmp_path) == documents.archive("{}", "2025-01-02", tmp_path) == ["2025-01-02"] and documents.archive("{}", "2025-01-01", tmp_path) == ["2025-01-01", "2025-01-02"]
    assert documents.mail(df, "2025-01-03", {"news": 3, "paper": 3})[0] == "Digest of 2025-01-03: 1 news, 1 papers"
    with pytest.raises(ValueError):
        documents.bounded(df, 1)
    documents.write_lines(df, str(tmp_path / "lines"), ["kind"])
    documents.write_xml(df, str(tmp_path / "xml"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2 and spark.read.format("xml").option("rowTag", "item").load(str(tmp_path / "xml")).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "n", "a", "x", 1, 1), (1, "n", "a", "x", 1, 1), (2, "n", "a", "y", 2, 2)], "id long, kind string, url string, title string, created_at int, updated_at int")
    path = str(tmp_path / "in")
    rows.withColumn("at", F.timestamp_seconds(F.lit(1736380800))).repartition(1).write.parquet(path)
    once = ingest.drain(ingest.once_each(ingest.landed(spark, path), ["id"], "at"))
    assert sorted(r["id"] for r in once.collect()) == [1, 2]
    target = Table(spark, scratch_path(spark, "target"), ["kind", "url"])
    ingest.drain(ingest.landed(spark, path).drop("at"), sink=ingest.merge_into(target))
    assert [r["title"] for r in target.read().collect()] == ["y"] and ingest.within_tolerance(ingest.landed(spark, path), "at", F.current_timestamp()).isStreaming


def test_command_line(spark, capsys, tmp_path):
    data = "/root/testdata/sf0.001"
    for command in (["items", "--limit", "2"], ["stats"], ["runs"], ["sources"], ["health"], ["usage"], ["categories"], ["duplicates"], ["usage-recent"], ["query", "items_stats"]):
        assert main(["--data", data, *command], spark) == 0
    assert "total" in capsys.readouterr().out
    assert main(["--data", data, "query", "none"], spark) == 2
    assert main(["--data", data, "export", str(tmp_path)], spark) == 0
