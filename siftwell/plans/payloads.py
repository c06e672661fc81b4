"""Queries over small payloads that are written out here, each with the rows that it must give: readers, times, addresses, answers."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text, times, urls
from siftwell.operators import answers, presentation, visibility
from siftwell.plans.registry import registry
from siftwell.sources import feeds, http, listings, papers, ranked

QUERIES, SQL, query = registry()

ZONE = "Asia/Shanghai"


def rows_of(*rows: str, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


def _texts(spark: SparkSession, values: list) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")


def _pages(spark: SparkSession, *payloads: bytes, source: str = "s") -> DataFrame:
    return spark.createDataFrame([(source, bytearray(p)) for p in payloads], "source_id string, payload binary")


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("s", "S", 1, "official", ["t"], ["e.com"], 2, 2, 10, 5)], "id string, name string, tier int, type string, tags array<string>, allowed_domains array<string>, max_items int, community_rank_limit int, community_min_points int, community_min_comments int"
    )


@query(
    rows_of(
        "(0, 'https://arxiv.org/abs/2501.00001')", "(1, 'https://arxiv.org/abs/2501.00001')", "(2, 'https://arxiv.org/abs/2501.00001')", "(3, 'https://arxiv.org/abs/cs.RO')", "(4, 'https://e.com/pdf/2501.00001v2.pdf')", "(5, 'https://e.com/a/b?a=1&b=2')", "(6, '')", columns="k, canonical"
    )
)
def paper_identity(spark: SparkSession, d: str) -> DataFrame:
    values = ["https://arxiv.org/pdf/2501.00001v2.pdf?download=1", "http://export.arxiv.org/abs/2501.00001v1", "arxiv.org/pdf/2501.00001.PDF#x", "https://arxiv.org/abs/cs.RO", "https://e.com/pdf/2501.00001v2.pdf", "https://WWW.e.com:443/a//b/?b=2&utm_source=x&a=1#top", None]
    return _texts(spark, values).select("k", urls.canonical_url(F.col("v")).alias("canonical"))


@query(rows_of("('p2', 'path')", "('p3', 'id')", "('p3', 'host')", "('p4', 'day')", "('p5', 'id')", "('p5', 'path')", "('p5', 'day')", columns="id, fault"))
def paper_identity_faults(spark: SparkSession, d: str) -> DataFrame:
    page = "https://arxiv.org/abs/"
    at, day = datetime(2025, 1, 8, 20), datetime(2025, 1, 9).date()
    rows = [("p1", "2501.00001", page + "2501.00001", at, day), ("p2", "2501.00001", page + "2501.00002", at, day), ("p3", "x", "https://e.com/abs/x", at, day), ("p4", "2501.00001", page + "2501.00001", at, datetime(2025, 1, 10).date()), ("p5", None, page + "1", None, day)]
    df = spark.createDataFrame(rows, "id string, external_id string, canonical_url string, at timestamp, announced date")
    return visibility.identity_faults(df, ["arxiv.org"], "America/New_York")


@query(rows_of("(0, 1736381167::BIGINT)", "(1, 1736381167::BIGINT)", "(2, 1736377567::BIGINT)", "(3, 1736381160::BIGINT)", "(4, NULL)", "(5, NULL)", columns="k, seconds"))
def mail_dates(spark: SparkSession, d: str) -> DataFrame:
    values = ["Thu, 09 Jan 2025 00:06:07 GMT", "2025-01-09T00:06:07Z", "Thu, 09 Jan 2025 00:06:07 +0100", "09 Jan 2025 00:06 GMT", "yesterday", None]
    return _texts(spark, values).select("k", F.unix_seconds(times.parsed(F.col("v"))).alias("seconds"))


@query(rows_of("(0, true, 1736381167::BIGINT)", "(1, false, 1735689600::BIGINT)", columns="k, sure, seconds"))
def dates_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    at, sure = times.parsed_or(F.col("v"), F.lit("2025-01-01").cast("timestamp"))
    return _texts(spark, ["2025-01-09T00:06:07Z", "soon"]).select("k", sure.alias("sure"), F.unix_seconds(at).alias("seconds"))


@query(rows_of("(0, 45.0::DOUBLE)", "(1, 60.0)", "(2, 0.0)", "(3, 0.0)", "(4, 0.0)", columns="k, wait"))
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, ["45", "Thu, 09 Jan 2025 00:01:00 GMT", "Thu, 09 Jan 2020 00:01:00 GMT", "x", None]).select("k", times.retry_wait(F.col("v"), F.lit("2025-01-09").cast("timestamp")).alias("wait"))


@query(rows_of("(429, 0, 'again', 30.0::DOUBLE)", "(429, 1, 'again', 60.0)", "(429, 2, 'give up', 0.0)", "(503, 0, 'again', 3.0)", "(503, 1, 'again', 6.0)", "(503, 2, 'give up', 0.0)", "(404, 0, 'give up', 0.0)", "(404, 1, 'give up', 0.0)", "(404, 2, 'give up', 0.0)", columns="status, attempt, action, wait"))
def retry_steps(spark: SparkSession, d: str) -> DataFrame:
    policy = http.Policy(retries=2, first_wait=3, first_wait_when_limited=30)
    steps = [(s, k, *http.next_step(policy, k, s)) for s in (429, 503, 404) for k in range(3)]
    return spark.createDataFrame([(s, k, a, float(w)) for s, k, a, w in steps], "status int, attempt int, action string, wait double")


@query(
    rows_of(
        "('paper', 'today', '2026-08-03', '2026-08-02 16:00:00', '2026-08-03 16:00:00')", "('paper', 'recent', '2026-08-03', '2026-07-30 10:00:00', '2026-08-03 16:00:00')", "('news', 'recent', '2026-08-03', '2026-07-30 10:00:00', NULL)", "('news', 'today', '2026-08-03', '2026-08-02 16:00:00', '2026-08-03 16:00:00')",
        "('news', 'all', '2026-08-03', NULL, NULL)", columns="kind, period, day, since, before",
    )
)
def period_windows(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, period in (("paper", "today"), ("paper", "recent"), ("news", "recent"), ("news", "today"), ("news", "all")):
        bounds = times.period_bounds(F.lit("2026-08-03 10:00:00").cast("timestamp"), ZONE, kind, period, 96)
        row = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(period).alias("period"), *(b.cast("string").alias(n) for b, n in zip(bounds, ("day", "since", "before"), strict=True)))
        out = row if out is None else out.unionByName(row)
    return out


@query(rows_of("(0, '2026-08-03 10:00:00')", "(1, '2026-08-03 10:00:00')", "(2, '2026-08-01 15:59:59.999999')", "(3, NULL)", "(4, NULL)", columns="k, moment"))
def reference_instants(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-08-03 10:00:00").cast("timestamp")
    return _texts(spark, ["", "2026-08-03", "2026-08-01", "2026-08-04", "x"]).select("k", times.reference_instant(F.col("v"), now, ZONE).cast("string").alias("moment"))


@query(rows_of("(0, true)", "(1, false)", "(2, false)", "(3, false)", columns="k, fresh"))
def pages_fresh(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-08-03 17:00:00").cast("timestamp")
    return _texts(spark, ["2026-08-03 16:00:00", "2026-08-03 15:59:59", "2026-08-04 16:00:00", None]).select("k", visibility.fresh(F.col("v").cast("timestamp"), now, ZONE).alias("fresh"))


@query(rows_of("(1)", "(2)", "(3)", columns="page"))
def pages_until(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.createDataFrame([(k, f"2026-08-0{9 - k} 00:00:00") for k in range(1, 7)], "page int, o string").select("page", F.col("o").cast("timestamp").alias("oldest"))
    return visibility.pages_needed(pages, F.lit("2026-08-06 12:00:00").cast("timestamp")).select("page")


@query(rows_of("(0, '{\"a\":1}')", "(1, '[1]')", "(2, 'plain')", "(3, '')", columns="k, bare"))
def fences_removed(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, ['```json\n{"a":1}\n```', "```\n[1]\n```", " plain ", ""]).select("k", text.without_fence(F.col("v")).alias("bare"))


@query(rows_of("(0, true)", "(1, false)", "(2, false)", "(3, false)", "(4, false)", columns="k, valid"))
def mail_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, ["a.b@e.com", "a@e", "a b@e.com", "a@e.com, b@e.com", None]).select("k", text.valid_address(F.col("v")).alias("valid"))


@query(rows_of("(0, '2501.00001', 2)", "(1, '2501.00001', 0)", "(2, '0501001', 12)", columns="k, id, version"))
def paper_versions(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, ["http://x.org/abs/2501.00001v2", "http://x.org/abs/2501.00001", "http://x.org/abs/cs.AI/0501001v12"]).select("k", text.paper_id(F.col("v")).alias("id"), text.paper_version(F.col("v")).alias("version"))


@query(rows_of("(0, 'https://github.com/a/b')", "(1, 'https://huggingface.co/x/y-z')", "(2, '')", columns="k, code"))
def code_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, ["See https://github.com/a/b.", "at https://huggingface.co/x/y-z, or https://gitlab.com/q", "https://e.com/github.com"]).select("k", text.code_url(F.col("v")).alias("code"))


@query(rows_of("(0, 'A & B c')", "(1, 'y')", "(2, '')", "(3, 'a b')", "(4, '1 < 2')", columns="k, plain"))
def html_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, ["<p>A &amp; B</p>  c", "<script>x</script>y<style>z</style>", None, "a&nbsp;b", "1 < 2"]).select("k", text.clean_html(F.col("v")).alias("plain"))


@query(rows_of("(0, 1.0::DOUBLE)", "(1, 0.0)", "(2, 0.8)", columns="k, likeness"))
def title_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Equal forms are alike, empty ones aren't; half the tokens in common beside a sequence ratio of 0.9444 give 0.8 after rounding up to tenths."""
    pairs = spark.createDataFrame([(0, "New AI model!", "new ai model"), (1, "", "x"), (2, "alpha beta gamma delta", "alpha beta gamma delta eps")], "k int, a string, b string")
    n = pairs.select("k", *(text.normalize_title(F.col(c)).alias(c) for c in "ab"))
    s = text.title_similarity(F.col("a"), text.title_tokens(F.col("a"), True), F.col("b"), text.title_tokens(F.col("b"), True))
    return n.select("k", F.round(s, 1).alias("likeness"))


@query(rows_of("(0, 'a|b')", "(1, 'c')", "(2, '')", columns="k, tokens"))
def unicode_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Full-width letters and ligatures in the form that a search compares."""
    values = ["Ａ Ｂ", "Ｃ", None]
    return _texts(spark, values).select("k", F.regexp_replace(F.lower(text.nfkc(F.coalesce("v", F.lit("")))), " ", "|").alias("tokens"))


@query(rows_of("(0, 12.0::DOUBLE, 12::BIGINT, 12)", "(1, NULL, 0, 1)", "(2, NULL, 0, 1)", "(3, NULL, 0, 1)", "(4, NULL, 500, 20)", "(5, 7.5, 0, 1)", columns="k, bounded, whole, clamped"))
def numbers_bounded(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return _texts(spark, ["12", "-3", "x", None, "500", "7.5"]).select("k", presentation.bounded_number(v, 0, 100).alias("bounded"), presentation.whole_number(v).alias("whole"), presentation.clamped(v, 1, 20).alias("clamped"))


@query("SELECT name, sha256(t) AS sha256, missing FROM (VALUES ('a', 'Judge {items} by {rules}', ''), ('b', 'Judge {items}', 'rules'), ('c', '', 'items,rules')) x(name, t, missing)")
def prompt_hashes(spark: SparkSession, d: str) -> DataFrame:
    return presentation.prompt_manifest(spark.createDataFrame([("a", "Judge {items} by {rules}"), ("b", "Judge {items}"), ("c", "")], "name string, text string"), ["items", "rules"])


_RSS = b"""<rss><channel><item><title>A &amp;amp; <![CDATA[<b>B</b>]]></title><link>https://www.e.com/a/?utm_source=x</link><guid>g1</guid><pubDate>Thu, 09 Jan 2025 00:06:07 GMT</pubDate>
<description><![CDATA[<p>Body</p>]]></description><category>x</category><category>x</category></item><item><title>no link</title></item><item><title>T</title><link>https://e.com/t</link><pubDate>soon</pubDate></item></channel></rss>"""
_ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="urn:o"><o:totalResults>7</o:totalResults><entry><id>http://x.org/abs/2501.00001v2</id><title>Paper</title><published>2025-01-09T00:00:00Z</published><updated>2025-01-10T00:00:00Z</updated>
<summary>See https://github.com/a/b.</summary><author><name>N. One</name></author><link rel="related" type="application/pdf" href="http://x.org/pdf/2501.00001v2"/><link href="http://x.org/abs/2501.00001v2"/><category term="cs.A"/></entry>
<entry><id>http://x.org/abs/2501.00002v1</id><title>Undated</title></entry></feed>"""


@query(rows_of("('A & B', 'https://e.com/a', 'Body', 'x', true, 1736381167::BIGINT, 'g1', 't', 1)", "('T', 'https://e.com/t', '', '', false, 1738368000, '', 't', 1)", columns="title, canonical_url, summary, labels, sure, seconds, guid, tags, tier"))
def feed_records(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.records(feeds.raw_entries(_pages(spark, _RSS)), _sources(spark), F.lit("2025-02-01").cast("timestamp"))
    return rows.select("title", "canonical_url", "summary", F.array_join("categories", "|").alias("labels"), F.col("published_at_verified").alias("sure"), F.unix_seconds("published_at").alias("seconds"), F.col("external_id").alias("guid"), F.array_join("tags", "|").alias("tags"), F.col("source_tier").alias("tier"))


@query(rows_of("('s', true)", columns="source_id, failed"))
def feed_failures(spark: SparkSession, d: str) -> DataFrame:
    found = feeds.failures(feeds.raw_entries(_pages(spark, _RSS, b"<broken")))
    return found.select("source_id", (F.col("error") != "").alias("failed"))


@query(rows_of("('2501.00001', 2, 'updated-version', 'https://github.com/a/b', 'N. One', 7, 'http://x.org/pdf/2501.00001v2', 2)", columns="id, version, kind, code, authors, total, pdf, entries"))
def paper_feed(spark: SparkSession, d: str) -> DataFrame:
    raw = feeds.raw_entries(_pages(spark, _ATOM))
    rows = feeds.paper_records(raw, F.lit("2025-02-01").cast("timestamp")).select(F.col("external_id").alias("id"), "version", F.col("version_type").alias("kind"), F.col("code_url").alias("code"), F.array_join("authors", "|").alias("authors"), "total", F.col("pdf_url").alias("pdf"))
    return rows.withColumn("entries", F.lit(raw.count()).cast("int"))


def _post(**change) -> dict:
    return {"id": 1, "status": "publish", "link": "https://e.com/p", "date_gmt": "2025-01-09T00:00:00", "title": {"rendered": "T"}, "content": {"rendered": "<p>B</p>", "protected": False}} | change


@query(rows_of("('1', 'https://e.com/p', 'T', 'B', 1736380800::BIGINT)", columns="id, url, title, summary, seconds"))
def posts_read(spark: SparkSession, d: str) -> DataFrame:
    bad = [_post(id=2, link="http://e.com/p"), _post(id=3, link="https://evil.com/p"), _post(id=4, date_gmt=""), _post(id=5, status="draft"), _post(id=6, content={"rendered": "B", "protected": True})]
    pages = _pages(spark, *(json.dumps([b, _post()]).encode() for b in bad[:1]), *(json.dumps([b]).encode() for b in bad))
    return feeds.posts(pages, _sources(spark)).select(F.col("external_id").alias("id"), "url", "title", "summary", F.unix_seconds("published_at").alias("seconds"))


@query(rows_of("('quiet', '2 entries and none valid')", columns="source_id, error"))
def sources_silent(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame([("quiet",), ("quiet",), ("fine",), (None,)], "source_id string")
    return papers.silent_sources(raw, spark.createDataFrame([("fine",)], "source_id string"))


@query(rows_of("('s', 'answered by evil.com')", columns="source_id, error"))
def sources_redirected(spark: SparkSession, d: str) -> DataFrame:
    return papers.redirected(spark.createDataFrame([("s", "https://www.e.com/feed"), ("s", "https://evil.com/feed"), ("s", "https://news.e.com/feed")], "source_id string, final_url string"), _sources(spark))


@query(rows_of("(1, '11', 12::BIGINT, 0::BIGINT, true, true)", "(3, '13', 99, 0, false, false)", columns="rank, id, points, comments, qualified, own_page"))
def stories_ranked(spark: SparkSession, d: str) -> DataFrame:
    order = ranked.ranks(_pages(spark, b"[11, 12, 13, 14, 15]"), 4)
    live = {"type": "story", "time": 1736380800, "descendants": 0}
    details = [live | {"id": 11, "title": "One", "score": 12}, {"id": 12, "type": "job", "time": 1, "title": "x"}, live | {"id": 13, "title": "Three", "url": "https://e.com/3", "score": 99}, live | {"id": 14, "title": "Gone", "dead": True}, live | {"id": 15, "title": "Beyond"}]
    rows = ranked.stories(order, spark.createDataFrame([(x["id"], json.dumps(x)) for x in details], "id long, payload string"), _sources(spark))
    return rows.select("rank", F.col("external_id").alias("id"), "points", "comments", "qualified", (F.col("url") == F.col("discussion_url")).alias("own_page"))


@query(rows_of("(12::BIGINT, 'left')", "(99, 'right')", columns="id, side"))
def details_missing(spark: SparkSession, d: str) -> DataFrame:
    order = ranked.ranks(_pages(spark, b"[11, 12]"), 5)
    return papers.missing_details(order.select("id"), spark.createDataFrame([(11,), (99,)], "id long"))


_ARTICLE = b'<html><meta property="og:title" content="M"><meta content="D" name="description"><script type="application/ld+json">{"@type":"BlogPosting","headline":"H","datePublished":"2025-01-09T00:00:00Z","author":{"name":"N"}}</script></html>'


@query(rows_of("(0, 'H', '', 'N', '2025-01-09T00:00:00Z')", "(1, 'M', 'D', '', '')", "(2, '', '', '', '')", columns="k, title, description, author, published"))
def article_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.createDataFrame([(0, bytearray(_ARTICLE)), (1, bytearray(_ARTICLE.replace(b"BlogPosting", b"Thing"))), (2, None)], "k int, payload binary")
    return pages.select("k", ranked.article_meta(F.col("payload")).alias("a")).select("k", "a.title", "a.description", "a.author", "a.published")


@query(rows_of("('7', 1, 'H', 'N', 1736380800::BIGINT)", columns="id, rank, title, author, seconds"))
def articles_ranked(spark: SparkSession, d: str) -> DataFrame:
    entries = spark.createDataFrame([("s", "7", 1, "", 3, 4), ("s", "8", 2, "T", 3, 4), ("s", "9", 3, "U", 1, 1)], "source_id string, id string, rank int, title string, points int, comments int")
    pages = spark.createDataFrame([("7", "https://e.com/post/7/", bytearray(_ARTICLE)), ("8", "https://e.com/post/9", bytearray(_ARTICLE)), ("9", "https://e.com/post/9", bytearray(_ARTICLE.replace(b"BlogPosting", b"Thing")))], "id string, final_url string, payload binary")
    return ranked.ranked_articles(entries, pages, _sources(spark)).select("id", "rank", "title", "author", F.unix_seconds("published_at").alias("seconds"))


@query(rows_of("(1, 'p1', 'T & U', 'https://e.com/a', 'D', 'N', 12::BIGINT, 0::BIGINT, true, 1735689600::BIGINT)", columns="rank, id, title, url, summary, author, points, comments, qualified, seconds"))
def hot_list_articles(spark: SparkSession, d: str) -> DataFrame:
    entry = {"articleDetailUrl": "https://e.com/a", "articleTitle": "T &amp; U", "hotRankScore": "12", "commentCount": None, "nickName": "N", "productId": "p1"}
    hot = [entry, entry | {"articleDetailUrl": "https://e.com/away"}, entry | {"articleDetailUrl": "https://e.com/undated"}, entry | {"articleDetailUrl": ""}, entry | {"articleDetailUrl": "https://e.com/unread"}, entry | {"articleTitle": ""}]
    page = b'<meta property="article:published_time" content="2025-01-01T00:00:00Z"><meta name="description" content="D">'
    pages = [("https://e.com/a", "https://e.com/a", page), ("https://e.com/away", "https://evil.com/a", page), ("https://e.com/undated", "https://e.com/u", b"<p>")]
    found = ranked.hot_list(_pages(spark, json.dumps(hot).encode()), spark.createDataFrame([(u, f, bytearray(b)) for u, f, b in pages], "url string, final_url string, payload binary"), _sources(spark))
    return found.select("rank", F.col("external_id").alias("id"), "title", "url", "summary", "author", "points", "comments", "qualified", F.unix_seconds("published_at").alias("seconds"))


def _entry(i: str, cross: str = "", primary: str = "cs.A", label: str | None = None) -> str:
    return f'<dt><a href="/abs/{i}v1" title="Abstract">arXiv:{label or i}</a> {cross}</dt><dd><div class="list-title"><span>Title:</span> T</div><div class="list-authors"><a href="#">N. One</a>, <a>M. Two</a></div><div class="list-comments">Comments: c</div><div class="list-subjects"><span class="primary-subject">Area ({primary})</span>; Other (cs.B)</div><p class="mathjax">Sum</p></dd>'


def _listing(*sections, total: int) -> bytes:
    body = "".join(f'<dl id="articles"><h3>{name} (showing {n} of {n} entries)</h3>{"".join(es)}</dl>' for name, n, es in sections)
    return f'<h3>Showing new listings for Friday, 9 January 2026</h3><div class="paging">Total of {total} entries</div>{body}'.encode()


def _listed(spark: SparkSession) -> DataFrame:
    a = _listing(("New submissions", 1, [_entry("2601.00001")]), ("Cross submissions", 3, [_entry("2601.00002", primary="cs.V"), _entry("2501.00003", primary="cs.V"), _entry("2601.00004", primary="cs.W")]), total=4)
    v = _listing(("New submissions", 2, [_entry("2601.00002", primary="cs.V"), _entry("2601.00004", primary="cs.W")]), total=2)
    bad = _listing(("New submissions", 2, [_entry("2601.00009", label="2601.00008")]), total=2)
    return listings.listed(spark.createDataFrame([("a", "cs.A", bytearray(a)), ("v", "cs.V", bytearray(v)), ("x", "cs.X", bytearray(bad))], "page_id string, category string, payload binary"))


@query(
    rows_of(
        "('a', '2601.00001', 'new', 'cs.A', 4, '2026-01-09', 'N. One|M. Two', 'cs.A|cs.B')", "('a', '2601.00002', 'cross', 'cs.V', 4, '2026-01-09', 'N. One|M. Two', 'cs.B|cs.V')", "('a', '2501.00003', 'cross', 'cs.V', 4, '2026-01-09', 'N. One|M. Two', 'cs.B|cs.V')", "('a', '2601.00004', 'cross', 'cs.W', 4, '2026-01-09', 'N. One|M. Two', 'cs.B|cs.W')",
        "('v', '2601.00002', 'new', 'cs.V', 2, '2026-01-09', 'N. One|M. Two', 'cs.B|cs.V')", "('v', '2601.00004', 'new', 'cs.W', 2, '2026-01-09', 'N. One|M. Two', 'cs.B|cs.W')", "('x', '2601.00009', 'new', 'cs.A', 2, '2026-01-09', 'N. One|M. Two', 'cs.A|cs.B')", columns="page, id, section, main, total, day, authors, labels",
    )
)
def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark).select(F.col("page_id").alias("page"), F.col("identifier").alias("id"), "section", F.col("primary").alias("main"), "total", F.col("day").cast("string").alias("day"), F.array_join("authors", "|").alias("authors"), F.array_join(F.array_sort("categories"), "|").alias("labels"))


@query(rows_of("('2601.00001', true)", "('2601.00002', true)", "('2601.00009', false)", "('2501.00003', false)", "('2601.00004', false)", columns="id, accepted"))
def listing_announced(spark: SparkSession, d: str) -> DataFrame:
    """What the listing of its own primary category has as new; that another category lists it as new isn't enough."""
    accepted, excluded = listings.announced(_listed(spark))
    return accepted.select(F.col("identifier").alias("id"), F.lit(True).alias("accepted")).unionByName(excluded.select(F.col("identifier").alias("id"), F.lit(False).alias("accepted")))


@query(rows_of("('x', 'section', 'new')", "('x', 'row', '2601.00009')", columns="page, fault, what"))
def listing_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = _listed(spark)
    a = listings.section_faults(rows).select(F.col("page_id").alias("page"), F.lit("section").alias("fault"), F.col("section").alias("what"))
    return a.unionByName(listings.row_faults(rows).select(F.col("page_id").alias("page"), F.lit("row").alias("fault"), F.col("identifier").alias("what")))


@query(rows_of("('2601.00001', '2026-01-09', 'new', NULL)", "('2601.00002', '2026-01-09', 'cross', 'cs.V')", columns="id, day, section, cross_from"))
def listing_recent(spark: SparkSession, d: str) -> DataFrame:
    page = '<div class="paging">Total of 3 entries</div><dl id="articles"><h3>Fri, 9 Jan 2026 (showing 2 of 2 entries )</h3>' + _entry("2601.00001") + _entry("2601.00002", cross="(cross-list from cs.V)", primary="cs.V") + "<h3>Thu, 8 Jan 2026</h3><p>No updates for this time period.</p></dl>"
    rows = listings.listed(spark.createDataFrame([("r", "cs.A", bytearray(page.encode()))], "page_id string, category string, payload binary"))
    return rows.select(F.col("identifier").alias("id"), F.col("day").cast("string").alias("day"), "section", "cross_from")


@query(rows_of("('b', 'totals differ')", "('c', 'incomplete')", "('c', 'repeated')", columns="\"group\", fault"))
def paging_faults(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.createDataFrame([("a", 3, 2), ("a", 3, 1), ("b", 3, 2), ("b", 4, 1), ("c", 5, 2)], "group string, total int, entries int")
    return papers.page_faults(pages, spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("c", "1"), ("c", "1")], "group string, id string"))


@query(rows_of("('https://x.org/q?search_query=%28cat%3Acs.A+OR+cat%3Acs.B%29+AND+submittedDate%3A%5B202601081400+TO+202601091359%5D&start=200&max_results=200&sortBy=submittedDate&sortOrder=descending')", "('https://x.org/q?search_query=cat%3Acs.A&start=0&max_results=200&sortBy=submittedDate&sortOrder=descending')", columns="address"))
def query_addresses(spark: SparkSession, d: str) -> DataFrame:
    made = [papers.query_url("https://x.org/q", ["cs.A", "cs.B"], datetime(2026, 1, 8, 14), datetime(2026, 1, 9, 14), 200), papers.query_url("https://x.org/q", ["cs.A"])]
    return spark.createDataFrame([(m,) for m in made], "address string")


@query(rows_of("('2026-01-08/digest.json', 'x')", "('2026-01-09/digest.json', 'y')", columns="path, body"))
def archive_restored(spark: SparkSession, d: str) -> DataFrame:
    kept = {"2026-01-08/digest.json": b"x", "2026-01-09/digest.json": b"y"}
    return spark.createDataFrame([(p, b.decode()) for p, b in papers.restored(["2026-01-09", "2026-01-08"], ["digest.json"], kept.get).items()], "path string, body string")


@query("SELECT id, kind, 'Example ' || kind || ' ' || n AS title, 100.0::DOUBLE - n * 10 AS score, n = 1 AS is_important FROM (SELECT id, CASE WHEN id <= 4 THEN 'news' ELSE 'paper' END AS kind, (id - 1) % 4 + 1 AS n FROM range(1, 9) t(id))")
def demo_records(spark: SparkSession, d: str) -> DataFrame:
    return papers.demo(spark).select("id", "kind", "title", "score", "is_important")


_CASES = [('[{"id":"a","ok":true}]', True), ('[{"id":"a","ok":1}]', False), ('[{"id":1,"ok":true}]', False), ('[{"id":"a"}]', False), ('[{"id":"a","ok":true,"more":1}]', False), ("[3]", False), ("not json", False), (None, False), ('```json\n{"items":[{"id":"b","ok":false}]}\n```', True)]


@query(rows_of(*(f"({k}::BIGINT, {str(v).lower()})" for k, (_, v) in enumerate(_CASES)), columns="batch, valid"))
def answers_parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(_CASES)], "batch long, content string")
    return answers.parsed(rows, {"id": "string", "ok": "boolean"}, exact=True).select("batch", "valid")


@query(rows_of("(0::BIGINT, 'a', 'repeated')", "(0, 'b', 'missing')", "(0, 'z', 'unknown')", columns="batch, id, fault"))
def answers_unmatched(spark: SparkSession, d: str) -> DataFrame:
    asked, told = (spark.createDataFrame([(0, i) for i in ids], "batch long, id string") for ids in ("ab", "aaz"))
    return answers.unmatched(asked, told)


@query(rows_of("(0::BIGINT, '2 rows', NULL)", "(1, NULL, 'RuntimeError: busy')", columns="batch, content, error"))
def answers_asked(spark: SparkSession, d: str) -> DataFrame:
    def service(batch: list[dict]) -> str:
        if any(b["id"] == 3 for b in batch):
            raise RuntimeError("busy")
        return f"{len(batch)} rows"

    return answers.ask(answers.batches(spark.range(1, 4).toDF("id"), 2), service, ["id"])
