import itertools
import random
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions.timestamps import CONVENTION, interpretations, item_interpretations
from siftwell.operators import timeline

NY = ZoneInfo("America/New_York")


def at(text, zone=None):
    found = interpretations(text, zone)
    best = min(found, key=lambda x: x[2])[0] if found else None
    return best and datetime.fromtimestamp(best / 1e6, UTC).isoformat()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2025-01-09 02:31:06", "2025-01-09T07:31:06+00:00"), ("2025-01-09T02:31:06Z", "2025-01-09T02:31:06+00:00"), (" 2025-01-09T02:31+01\n", "2025-01-09T01:31:00+00:00"), ("Mon, 10 Mar 2025 13:01:54 EDT", "2025-03-10T17:01:54+00:00"),
        ("02/03/2025 5:00 PM", "2025-02-03T22:00:00+00:00"), ("07.08.2025 05:42", "2025-08-07T09:42:00+00:00"), ("1737572923", "2025-01-22T19:08:43+00:00"), ("20250124T074616Z", "2025-01-24T07:46:16+00:00"), ("2025年3月13日 18:48", "2025-03-13T22:48:00+00:00"),
        ("January 17, 2025 at 12:59 AM", "2025-01-17T05:59:00+00:00"), ("Fri Jan 10 03:59:14 UTC 2025", "2025-01-10T03:59:14+00:00"), ("2025-01-30 13:13:58 Asia/Tokyo", "2025-01-30T04:13:58+00:00"), ("2025-02-07T12:08:13+09:00[Asia/Tokyo]", "2025-02-07T03:08:13+00:00"),
        ("2025-11-02 01:30:00", "2025-11-02T05:30:00+00:00"), ("2025-01-11", None), ("20250201", None), ("2025-13-40", None), ("0000-00-00 00:00:00", None), ("just now", None), ("", None), (None, None), ("25/12/2025 10:00 AM", "2025-12-25T15:00:00+00:00"),
    ],
)
def test_readings(text, want):
    assert at(text, NY) == want


def test_own_value_first_then_the_feeds():
    assert item_interpretations("2025-01-11", "2025-01-11 10:00", "Asia/Tokyo", None)[0][0] == 1736557200 * 10**6
    assert item_interpretations(None, "soon", None, None) == [] and item_interpretations("x", None, "No/Zone", None) == []


def brute(rows):
    """The cheapest path by trying all."""
    best = min(itertools.product(*(range(len(r[0])) for r in rows)), key=lambda p: rows[0][2][p[0]] + sum(timeline._step(rows[k], rows[k + 1])[p[k], p[k + 1]] for k in range(len(rows) - 1)))
    return [int(r[0][k]) for r, k in zip(rows, best, strict=True)]


def cost(rows, chosen):
    at_ = [list(r[0]).index(c) for r, c in zip(rows, chosen, strict=True)]
    return rows[0][2][at_[0]] + sum(timeline._step(rows[k], rows[k + 1])[at_[k], at_[k + 1]] for k in range(len(rows) - 1))


def test_blocks_give_the_cheapest_path(spark):
    rng = random.Random(3)
    for trial in range(3):
        data, rows = [], []
        for i in range(8):
            n = rng.choice([1, 2, 3])
            us = sorted(rng.sample(range(10), n))
            r = ([u * 86_400_000_000 for u in us], [rng.randrange(3) for _ in us], [rng.choice([0.0, 0.5, CONVENTION]) for _ in us])
            rows.append(tuple(np.asarray(x) for x in r))
            data.append((i, "s", i // 3, *r))
        found = spark.createDataFrame(data, timeline._CANDIDATES)
        got = {r["id"]: r["utc_us"] for r in timeline.choose(found).collect()}
        assert cost(rows, [got[i] for i in range(8)]) == pytest.approx(cost(rows, brute(rows))), trial


SOURCES = [("a", "America/New_York"), ("b", None)]


def test_records(spark):
    sources = spark.createDataFrame(SOURCES, "id string, time_zone string")
    rows = [
        (1, "a", "2025-01-09 02:31:06", None, "x"), (2, "b", "2025-01-09 02:31:06.999999", '{"feed_tz":"Asia/Tokyo"}', "x"), (3, "c", "TBA", '{"published_raw":"2025-01-09T00:00:00Z"}', "x"), (4, None, None, None, "x"),
        (5, "a", "2025-01-09T02:31:06+00:00", None, "x"), (5, "a", "2025-01-09T02:31:06+00:00", None, "x"), (6, "a", "soon", "not json", None), (7, "a", "x" * 100_000, None, None), (None, "a", "2025-01-09T02:31:06Z", None, None),
    ]
    items = spark.createDataFrame(rows, "id long, source_id string, published_at string, metadata_json string, time_zone string")
    got = {r["id"]: r["utc_ms"] for r in timeline.normalised(items, sources).collect()}
    assert got == {1: 1736407866000, 2: 1736357466999, 3: 1736380800000}
    assert timeline.normalised(items.limit(0), sources).count() == 0
    assert {r["id"] for r in timeline.instants(items.drop("metadata_json"), sources).collect()} == {1, 2, 5}


def test_context_settles_an_ambiguous_zone(spark):
    rows = [(1, "a", "2025-06-01T00:00:00Z"), (2, "a", "Sun, 01 Jun 2025 08:30:00 CST"), (3, "a", "2025-06-01T01:00:00Z")]
    items = spark.createDataFrame(rows, "id long, source_id string, published_at string")
    got = {r["id"]: r["utc_us"] for r in timeline.instants(items, spark.createDataFrame(SOURCES, "id string, time_zone string")).collect()}
    assert got[2] == int(datetime(2025, 6, 1, 0, 30, tzinfo=UTC).timestamp() * 1e6)
    assert isinstance(pd.Series([got[1]])[0].item(), int) and F is not None


def test_sparse_ids_fill_blocks_like_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(timeline, "BLOCK_IDS", 8)
    sources = spark.createDataFrame(SOURCES, "id string, time_zone string")
    rows = [(k, "a", f"2025-06-01T{k % 24:02d}:30:00Z" if k % 3 else f"Sun, 01 Jun 2025 {k % 24:02d}:30:00 CST") for k in range(60)]
    out = []
    for spread in (1, 10**13):
        df = spark.createDataFrame([(i * spread - spread, *r) for i, *r in rows], "id long, source_id string, published_at string")
        found = timeline.candidates(df, sources)
        blocks = found.groupBy("block").count().collect()
        assert 5 <= len(blocks) <= 10 and max(b["count"] for b in blocks) <= 16
        out.append({(r["id"] + spread) // spread: r["utc_us"] for r in timeline.choose(found).collect()})
    assert out[0] == out[1] and len(out[0]) == 60


def test_a_clock_time_shown_twice_has_both_readings(spark):
    first = int(datetime(2025, 11, 2, 5, 30, tzinfo=UTC).timestamp()) * 10**6
    assert [(u - first, c) for u, _, c in interpretations("2025-11-02 01:30:00", NY)] == [(0, 0.0), (3600 * 10**6, CONVENTION)]
    assert [c for *_, c in interpretations("25/10/2025 02:30", ZoneInfo("Europe/Paris"))] == [0.0]
    assert len(interpretations("2025-03-09 02:30:00", NY)) == 1 and len(interpretations("2025-11-02 01:30:00 EDT", NY)) == 1  # skipped, and told by its zone
    assert [c for *_, c in interpretations("26/10/2025 02:30", ZoneInfo("Europe/Paris"))] == [0.0, CONVENTION]  # no month 26: what is left is ranked anew
    rows = [(k, "a", f"2025-11-02 {t}:00") for k, t in enumerate(("00:50", "01:10", "01:40", "01:10", "01:50", "02:05"))]
    items, sources = spark.createDataFrame(rows, "id long, source_id string, published_at string"), spark.createDataFrame(SOURCES, "id string, time_zone string")
    hours = {}
    for convention in (CONVENTION, 0.0):
        got = {r["id"]: (r["utc_us"] - first) / 60e6 for r in timeline.instants(items, sources, convention).collect()}
        hours[convention] = [got[k] for k in range(6)]
    assert hours[CONVENTION] == [-40, -20, 10, -20, 20, 95]  # TESTDATA: the first counts
    assert hours[0.0] == [-40, -20, 10, 40, 80, 95]  # context: time runs on
