import html
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import text, times, urls


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("v")).alias("x")).first()["x"]


def many(spark, values, column):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_html(spark):
    assert many(spark, ["<p>A &amp; B</p>  c", "<script>x</script>y<style>z</style>", None, "", "a&nbsp;b", "1 < 2"], text.clean_html) == ["A & B c", "y", "", "", "a b", "1 < 2"]


def test_canonical_urls(spark):
    got = many(spark, ["https://WWW.Example.com/a//b/?utm_source=x&b=2&a=1#top", "http://e.com:80/", "https://e.com:8443/x/", "e.com/y", None, "https://e.com/?z=", "https://e.com/?q=%C3%A9&ref=1"], urls.canonical_url)
    assert got == ["https://example.com/a/b?a=1&b=2", "http://e.com/", "https://e.com:8443/x", "https://e.com/y", "", "https://e.com/", "https://e.com/?q=%C3%A9"]


def test_canonical_urls_of_odd_forms(spark):
    want = {
        "https://user:pw@e.com:443/x": "https://e.com/x", "HTTP://E.com:0080": "http://e.com/", "//e.com/a": "https://e.com/a", "e.com:8080/y?b": "https://e.com:8080/y", "https://e.com/?b=2&amp;a=1": "https://e.com/?a=1&b=2",
        "https://e.com/?q=a%20b&q=a+a": "https://e.com/?q=a+a&q=a+b", "https://e.com/?q=%zz~*": "https://e.com/?q=%25zz~%2A", "https://e.com/?UTM_x=1&Ref=2&source=3&z=a=b": "https://e.com/?z=a%3Db", "": "", "  https://e.com//a///b//  ": "https://e.com/a/b",
        "https://e.com/?a=1#x?b=2": "https://e.com/?a=1", "https://e.com?x=1": "https://e.com/?x=1",
    }
    assert dict(zip(want, many(spark, list(want), urls.canonical_url), strict=True)) == want


def test_papers_have_one_address(spark):
    page = "https://arxiv.org/abs/2501.00001"
    same = ["https://arxiv.org/pdf/2501.00001v2.pdf", "http://export.arxiv.org/abs/2501.00001v1", "https://www.arxiv.org/pdf/2501.00001.PDF?download=1", "arxiv.org/abs/2501.00001#x", page]
    assert set(many(spark, same, urls.canonical_url)) == {page}
    assert many(spark, ["https://arxiv.org/list/cs.RO/new", "https://e.com/pdf/2501.00001v2.pdf"], urls.canonical_url) == ["https://arxiv.org/list/cs.RO/new", "https://e.com/pdf/2501.00001v2.pdf"]


def test_page_keys(spark):
    same = ["https://www.e.com:443/a//b/?b=1&a=2&utm_x=1#f", "https://E.com/a/b?a=2&b=1&spm=3"]
    a, b, other, none, blank = many(spark, [*same, "https://e.com/a/B?a=2&b=1", None, ""], urls.page_key)
    assert a == b != other and none is None and blank is None


def test_domains(spark):
    rows = spark.createDataFrame([("https://news.e.com/x", ["e.com"]), ("https://e.com.evil.org", ["e.com"]), ("https://www.e.com", ["www.E.com"]), ("", ["e.com"]), (None, ["e.com"]), ("https://e.com", [])], "u string, d array<string>")
    assert [r["x"] for r in rows.select(urls.domain_allowed(F.col("u"), F.col("d")).alias("x")).collect()] == [True, False, True, False, False, False]


def test_titles(spark):
    normal = many(spark, ["The Robots, &amp; the  Ｌａｂｓ!", "机器人-3", None, "Straße² é́"], text.normalize_title)
    assert normal[:3] == ["the robots the labs", "机器人-3", ""]
    tokens = many(spark, ["The robots are racing with boxed labels 7", "机器人", None], text.title_tokens)
    assert tokens == [["robot", "racing", "boxed", "label"], [], []] or tokens[0] == ["robot", "racing"[:-3] if len("racing") > 6 else "racing", "boxed"[: -2 if len("boxed") > 5 else 5], "label"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="<>\x00"), max_size=12), min_size=1, max_size=20))
def test_normal_titles_against_python(spark, values):
    def brute(v):
        v = " ".join(html.unescape(v).split())
        v = unicodedata.normalize("NFKC", v).lower()
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s一-鿿-]", " ", v)).strip()

    simple = [v for v in values if all(unicodedata.category(c)[0] in "LNPZ" and ord(c) < 0x3000 and c.lower() == c.casefold() for c in v) and "&" not in v]
    got = many(spark, simple, text.normalize_title) if simple else []
    for v, g in zip(simple, got, strict=True):
        assert g.replace(" ", "") == brute(v).replace(" ", ""), v


def test_similarity(spark):
    pairs = [("Model beats humans at chess", "Humans beat by model at chess"), ("a", "a"), ("", "x"), ("two words", "two worlds")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    n = {c: text.normalize_title(F.col(c)) for c in "ab"}
    t = {c: text.title_tokens(F.col(c)) for c in "ab"}
    got = [r["s"] for r in df.select("i", text.title_similarity(n["a"], t["a"], n["b"], t["b"]).alias("s")).orderBy("i").collect()]
    assert got[1] == 1.0 and got[2] == 0.0 and got[0] > 0.6 and 0.8 < got[3] < 1


def test_terms_and_lists(spark):
    assert one(spark, "ai labs train", lambda c: text.matched_terms(c, [("ai", "AI"), ("train", "T"), ("in", "IN")])) == ["AI", "T"]
    assert one(spark, "fair", lambda c: text.has_term(c, "ai")) is False and one(spark, "released", lambda c: text.has_term(c, "releas")) is True
    assert one(spark, "x a", lambda c: text.term_weight(c, [("a", 1.5), ("x", 2)])) == 3.5
    assert one(spark, [" a", "b", "a", "", None], text.unique_in_order, "v array<string>") in (["a", "b"], ["a", "b", None])
    assert one(spark, None, text.unique_in_order, "v array<string>") == []
    assert one(spark, "```json\n{}\n```", text.without_fence) == "{}"
    assert one(spark, "see https://github.com/a/b. And", text.code_url) == "https://github.com/a/b"
    assert one(spark, "http://x.org/abs/2501.00001v3", text.paper_id) == "2501.00001" and one(spark, "http://x.org/abs/2501.00001v3", text.paper_version) == 3
    assert many(spark, ["a@b.co", "a b@c.d", None], text.valid_address) == [True, False, False]
    assert one(spark, "The  Quick\nfox", lambda c: text.contains_all(c, F.array(F.lit("quick fox")))) is True
    assert one(spark, "x", lambda c: text.contains_all(c, F.array().cast("array<string>"))) is False


def test_times(spark):
    got = many(spark, ["Thu, 09 Jan 2025 00:06:07 +0100", "2025-01-09T00:06:07Z", "2025-01-09 00:06", "Thu, 09 Jan 2025 00:06:07 GMT", "soon", None], lambda c: F.unix_seconds(times.parsed(c)))
    assert got == [1736377567, 1736381167, 1736381160, 1736381167, None, None]
    assert many(spark, ["45", "", "x", None], lambda c: times.retry_wait(c, F.lit("2025-01-01").cast("timestamp"))) == [45.0, 0.0, 0.0, 0.0]
    assert one(spark, 13.0, lambda c: times.step_by_age(c, [(12, 1), (24, 0.85)], 0.2), "v double") == 0.85
    assert one(spark, 430, lambda c: times.phase(c, [("news", 420, 480), ("publish", 480, 630)]), "v int") == "news"


def test_windows(spark):
    def window(now, *how):
        return tuple(map(str, spark.range(1).select(*times.period_bounds(F.lit(now).cast("timestamp"), "Asia/Shanghai", *how)).first()))

    now = "2026-08-03 10:00:00"
    assert window(now, "paper", "today", 96) == ("2026-08-03", "2026-08-02 16:00:00", "2026-08-03 16:00:00") == window(now, "paper", "auto", 96)
    assert window(now, "paper", "recent", 96) == ("2026-08-03", "2026-07-30 10:00:00", "2026-08-03 16:00:00")
    assert window(now, "news", "auto", 48, 1) == ("2026-08-03", "2026-08-01 10:00:00", "None") and window(now, "news", "all", 48)[1:] == ("None", "None")
    assert window(now, "paper", "recent", 24, 1) == ("2026-08-02", "2026-08-01 15:59:59.999999", "2026-08-02 16:00:00")
    for at, day in (("2026-11-17 23:00:00", "2026-11-17"), ("2027-01-01", "2026-12-31"), ("2026-03-09", "2026-03-08")):
        assert window(at, "paper", "today", 24, 1)[0] == day
    days = ["", "2026-08-03", "2026-08-01", "2026-08-04", "2026-8-1", "x"]
    got = [str(v) for v in many(spark, days, lambda c: times.reference_instant(c, F.lit(now).cast("timestamp"), "Asia/Shanghai"))]
    assert got == [now, now, "2026-08-01 15:59:59.999999", "None", "None", "None"]


def test_announcements(spark):
    cal = {str(r["day"]): r for r in times.announcement_calendar(spark, "2025-12-25", "2026-11-30", ["2026-09-07", "2026-10-12", "2026-11-11"]).collect()}
    utc = lambda r: [str(r[k]) for k in ("since", "before", "announced")]
    assert utc(cal["2026-08-30"]) == ["2026-08-27 18:00:00", "2026-08-28 18:00:00", "2026-08-31 00:00:00"]
    assert utc(cal["2026-01-04"]) == ["2026-01-01 19:00:00", "2026-01-02 19:00:00", "2026-01-05 01:00:00"]
    assert utc(cal["2026-09-08"])[:2] == ["2026-09-04 18:00:00", "2026-09-08 18:00:00"]
