import random

import pytest

from siftwell.llm import mixing

DOCS = "doc_id long, text string, source string, lang string, tokens string, rest string, mix string"
TARGETS = "mix string, source string, target_weight double, max_repeats int"


def frames(spark, docs, targets, sources):
    return spark.createDataFrame([(*d, "clash", "clash", "clash") for d in docs], DOCS), spark.createDataFrame(targets, TARGETS), spark.createDataFrame(sources, "id string, type string")


def docs_of(seed=1, hot=200):
    rng, out = random.Random(seed), []
    for source, n, lang in (("big", hot, "en"), ("mid", 40, "en"), ("small", 6, "de"), ("other", 60, "fr")):
        out += [(len(out) + k, "word " * rng.randrange(5, 60), source, lang) for k in range(n)]
    return out + [(9000, None, "big", "en"), (9001, "", "big", "en"), (9002, "lost", None, None)]


SOURCES = [("big", "media"), ("mid", "media"), ("small", "media"), ("other", "official")]
GOALS = [("m", "big", 1.0, 1), ("m", "mid", 1.0, 2), ("m", "small", 1.0, 3), ("m", "other", 1.0, 2), ("m", "absent", 2.0, 4), ("n", "small", 0.3, 2), ("n", "other", 0.7, None), ("z", "big", 0.0, 1), (None, "big", 1.0, 1)]


def test_shares(spark):
    rows = mixing.shares(*frames(spark, docs_of(), GOALS, SOURCES)).collect()
    by = {(r["mix"], r["source"]): r for r in rows}
    assert set(by) == {("m", s) for s in ("big", "mid", "small", "other", "absent")} | {("n", "small"), ("n", "other"), ("z", "big")}
    longest = 60
    for r in rows:
        assert r["taken"] <= r["budget"] <= r["tokens"] * r["max_repeats"] and r["repeats"] <= r["max_repeats"]
        assert r["taken"] >= r["budget"] - longest  # only the last document that no longer fits is missing
    assert by["m", "absent"]["taken"] == 0 and by["z", "big"]["taken"] == 0 and by["m", "small"]["repeats"] == 3
    m = [r for r in rows if r["mix"] == "m"]
    assert abs(sum(r["actual_share"] for r in m) - 1) < 1e-9 and abs(sum(r["target_share"] for r in m) - 1) < 1e-9
    assert sum(r["budget"] for r in m) >= sum(r["tokens"] for r in m) - 5


def test_selection_is_whole_epochs_and_a_prefix(spark):
    a, b = (mixing.selected(*frames(spark, docs_of(), GOALS, SOURCES)).collect() for _ in range(2))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    keys = [(r["mix"], r["epoch"], r["doc_id"]) for r in a]
    assert len(keys) == len(set(keys)) and not {9000, 9001, 9002} & {r["doc_id"] for r in a}
    for mix, source, n in (("m", "small", 6), ("m", "mid", 40)):
        epochs = sorted({r["epoch"] for r in a if (r["mix"], r["source"]) == (mix, source)})
        for e in epochs[:-1]:
            assert len([r for r in a if (r["mix"], r["source"], r["epoch"]) == (mix, source, e)]) == n


def test_shortage_goes_to_siblings_first():
    leaf = lambda d, g, s, w, most: {"domain": d, "lang": g, "source": s, "weight": w, "most": most}
    got = mixing.budgets([leaf("a", "en", "x", 1, 10), leaf("a", "en", "y", 1, 1000), leaf("a", "de", "z", 1, 1000), leaf("b", "en", "u", 1, 1000)], 400)
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): pytest.approx(190), ("a", "de", "z"): pytest.approx(100), ("b", "en", "u"): pytest.approx(100)}
    got = mixing.budgets([leaf("a", "en", "x", 1, 10), leaf("a", "de", "z", 1, 20), leaf("b", "en", "u", 2, 1000)], 100)
    assert got == {("a", "en", "x"): 10, ("a", "de", "z"): 20, ("b", "en", "u"): pytest.approx(70)}
    assert sum(mixing.budgets([leaf("a", "en", "x", 1, 10)], 100).values()) == 10 and mixing.budgets([], 5) == {}


def test_empty(spark):
    docs, targets, sources = frames(spark, docs_of(), GOALS, SOURCES)
    assert mixing.selected(docs.limit(0), targets, sources).count() == 0 and mixing.shares(docs, targets.limit(0), sources).count() == 0


def test_sources_of_several_languages_and_a_total(spark):
    docs = [(k, "word " * (5 + k % 7), "two", "en" if k % 3 else "de") for k in range(90)] + [(100 + k, "word " * 9, "mono", "de") for k in range(40)] + [(300, "word " * 8, "two", None)]
    goals, sources = [("m", "two", 3.0, 2), ("m", "mono", 1.0, 2)], [("two", "media"), ("mono", "media")]
    f = frames(spark, docs, goals, sources)
    rows = mixing.selected(*f, total=800).collect()
    assert 800 - 3 * 60 <= sum(r["tokens"] for r in rows) <= 800
    assert {(r["source"], r["lang"]) for r in rows} >= {("two", "en"), ("two", "de"), ("mono", "de")} and all(r["domain"] == "media" for r in rows)
    lang = {d[0]: d[3] or "" for d in docs}
    assert all(lang[r["doc_id"]] == r["lang"] for r in rows)
    got = {r["source"]: r["actual_share"] for r in rows}
    assert abs(got["two"] - 0.75) < 0.1 and abs(sum(r["tokens"] for r in rows if r["source"] == "two") / sum(r["tokens"] for r in rows) - got["two"]) < 1e-9
    every = mixing.selected(*f, total=10**9).collect()  # more than there is: all that may be repeated, and no more
    assert len(every) == 2 * len(docs) and {r["epoch"] for r in every} == {1, 2}
