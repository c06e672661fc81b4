import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftwell.llm import history
from siftwell.llm.likeness import words_of
from siftwell.session import scratch_path

DAY = 86_400_000_000
VOCABULARY = [f"w{i}" for i in range(300)]
SCHEMA = "id long, batch_id int, title string, summary string, canonical_url string, fingerprint string, published_at string, source_id string, us long, cell string, page string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, b, t, s, u, f, p, "s", 1, "clash", "clash", "clash") for i, b, t, s, u, f, p in rows], SCHEMA)


def corpus(seed, n=90, incoming=60):
    rng = random.Random(seed)
    bases = [[rng.choice(VOCABULARY) for _ in range(50)] for _ in range(25)]

    def row(i, batch):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 2, 4, 20])):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        url = rng.choice([None, "", f"https://www.e.com/{rng.randrange(60)}/?utm_source=x", f"https://e.com/{rng.randrange(60)}"])
        at = f"2025-01-{rng.randrange(1, 12):02d}T00:00:00Z" if rng.random() < 0.95 else None
        return (i, batch, " ".join(w[:5]), rng.choice([" ".join(w[5:])] * 9 + [None]), url, rng.choice([None, "", f"f{rng.randrange(40)}"]), at)

    return [row(i, 0) for i in range(n)], [row(1000 + i, 1 + i * 4 // incoming) for i in range(incoming)]


def brute(items, incoming):
    def known(r):
        i, _, t, s, u, f, p = r
        w = words_of(t, s)
        page = u.replace("www.", "").split("/?")[0] if u else None
        return i, page, f or None, p and int(p[8:10]), set(zip(w, w[1:], strict=False)) if w else None

    accepted, out = [known(r) for r in items], set()
    for r in map(known, sorted(incoming, key=lambda r: (r[1], r[0]))):
        hits = set()
        for a in accepted:
            near = a[3] is not None and r[3] is not None and abs(a[3] - r[3]) <= 3
            alike = a[4] and r[4] and len(a[4] & r[4]) / len(a[4] | r[4]) >= 0.5
            if (a[1] and a[1] == r[1]) or (near and ((a[2] and a[2] == r[2]) or alike)):
                hits.add((a[0], r[0]))
        out |= hits
        if not hits:
            accepted.append(r)
    return out


def times(df):
    return df.where("published_at is not null").select("id", F.unix_micros(F.to_timestamp("published_at")).alias("utc_us"))


@pytest.mark.parametrize("seed, one_task", [(1, 0), (2, 1_000_000)])
def test_all_batches_at_once(spark, monkeypatch, seed, one_task):
    monkeypatch.setattr(history, "ONE_TASK", one_task)
    items, incoming = corpus(seed)
    a, b = frame(spark, items), frame(spark, incoming + [incoming[0]])
    got = history.History.build(a, times(a)).check(b, times(b.distinct()))
    assert {tuple(r) for r in got.collect()} == brute(items, incoming)


def test_batch_after_batch_is_the_same(spark):
    items, incoming = corpus(3, 60, 40)
    a, b = frame(spark, items), frame(spark, incoming)
    kept = history.History.build(a, times(a), scratch_path(spark, "kept"))
    got = set()
    for k in range(1, 5):
        batch = b.where(F.col("batch_id") == k)
        got |= {tuple(r) for r in kept.check(batch, times(batch), f"batch{k}").collect()}
    assert got == brute(items, incoming)


def test_copies_in_bulk(spark):
    text = " ".join(VOCABULARY[:40])
    incoming = [(1000 + i, 1, "t", text, "https://e.com/x", "f", "2025-01-05T00:00:00Z") for i in range(30)]
    a, b = frame(spark, []), frame(spark, incoming)
    got = {tuple(r) for r in history.History.build(a, times(a)).check(b, times(b)).collect()}
    assert got == {(1000, 1000 + i) for i in range(1, 30)}


def test_rows_without_a_rule_are_no_copies(spark):
    text, at = " ".join(VOCABULARY[:40]), "2025-01-05T00:00:00Z"
    kinds = [(None, None, None, at), (None, "", " ", at), ("too short", None, None, at), (text, None, None, None), (None, None, "f", None), (text, "", "g", None), (None, None, None, None)]
    incoming = [(1000 + 2 * k + x, 1 + x, "t", *kind) for k, kind in enumerate(kinds) for x in range(2)]
    incoming += [(1100 + x, 1, "t", *kind) for x, kind in enumerate([(text, None, None, at)] * 2 + [(None, None, "h", at)] * 2 + [(None, "https://e.com/y", None, None)] * 2)]
    a, b = frame(spark, []), frame(spark, incoming)
    got = {tuple(r) for r in history.History.build(a, times(a)).check(b, times(b)).collect()}
    assert got == {(1100, 1101), (1102, 1103), (1104, 1105)}


def test_support_skips_cells_and_loses_none(spark):
    """Every pair that is alike lies in a cell that is probed, and most other cells are skipped."""
    rng = random.Random(9)
    topics = [[f"t{k}x{j}" for j in range(120)] for k in range(30)]
    rows = [(i, 0, "t", " ".join(rng.choice(topics[i % 30]) for _ in range(60)), None, None, f"2025-01-{1 + i % 3:02d}T00:00:00Z") for i in range(600)]
    a = frame(spark, rows)
    b = frame(spark, [(1000 + i, 1, t, " ".join([*s.split()[:50], "new", "end"]), u, f, p) for i, _, t, s, u, f, p in rows[:40]])
    kept = history.History.build(a, times(a), scratch_path(spark, "kept"))
    heads = history._placed(history._vectorised(b, times(b)), times(b))
    probes = kept.probes(heads, sorted({r["slab"] for r in heads.select("slab").distinct().collect()})).where("part != ''").collect()
    assert sum(r["probed"] for r in probes) < 0.4 * sum(r["suit"] for r in probes)
    got = {tuple(r) for r in kept.check(b, times(b)).collect()}
    assert got == brute(rows, [(1000 + i, 1, t, " ".join([*s.split()[:50], "new", "end"]), u, f, p) for i, _, t, s, u, f, p in rows[:40]]) and len(got) >= 40


def test_overlaps_by_planes_are_plain_counts():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    for cells, queries, most in ((1, 1, 1), (70, 9, 40), (130, 3, 300)):
        support = rng.random((cells, history.SUPPORT)) < 0.2
        table = pa.table({"support": pa.array([x.tobytes() for x in np.packbits(support, axis=1, bitorder="little")], pa.binary())})
        at = rng.integers(0, history.SUPPORT + 1, (queries, most)).astype("int32")
        padded = np.concatenate([support.T, np.zeros((1, cells), bool)])
        counts, least = padded[at].sum(1), rng.integers(0, most + 2, queries)
        q, c, n = history._reached(history._overlaps(history._held_by(table), at), least, cells)
        assert set(zip(q.tolist(), c.tolist(), n.tolist(), strict=True)) == {(i, j, counts[i, j]) for i in range(queries) for j in range(cells) if counts[i, j] >= least[i]}


def test_cells_are_of_about_their_size(spark):
    rng = random.Random(12)
    rows = [(i, 0, "t", " ".join(rng.choice(VOCABULARY) for _ in range(50)), None, None, "2025-01-05T00:00:00Z") for i in range(800)]
    df = frame(spark, rows)
    sizes = [r["count"] for r in history._placed(history._vectorised(df, times(df)), times(df)).groupBy("cell").count().collect()]
    assert sum(sizes) == 800 and len(sizes) > 0.9 * 800 / history.CELL_ROWS and max(sizes) < 4 * history.CELL_ROWS


def test_very_long_texts(spark):
    text = " ".join(f"w{k}" for k in range(70_000))
    a = frame(spark, [(1, 0, "t", text, None, None, "2025-01-05T00:00:00Z"), (2, 0, "t", None, None, None, None)])
    b = frame(spark, [(10, 1, "t", text.replace("w100 ", "other "), None, None, "2025-01-05T00:00:00Z")])
    assert [tuple(r) for r in history.History.build(a, times(a)).check(b, times(b)).collect()] == [(1, 10)]


def test_a_check_reads_only_folders_near_its_rows(spark):
    text = " ".join(VOCABULARY[:40])
    a = frame(spark, [(i, 0, "t", text, None, "f", f"2025-{1 + i % 6:02d}-10T00:00:00Z") for i in range(30)])
    b = frame(spark, [(1000, 1, "t", text, None, "f", "2025-03-11T00:00:00Z"), (1001, 2, "t", text, None, "f", "2025-09-11T00:00:00Z")])
    kept = history.History.build(a, times(a), scratch_path(spark, "kept"))
    assert {tuple(r) for r in kept.check(b, times(b), "late").collect()} == {(i, 1000) for i in range(2, 30, 6)}
    every = list(range(6600, 7200))  # slabs of all the days there are
    march = [r["slab"] for r in kept.rows(every).where("id = 2").select("slab").collect()]
    assert kept.rows(every).count() == 31 and len(march) == 1  # 1001 has no relative and was appended
    others = [f for f in Path(kept.path).glob("*/part=*/era=*/*.parquet") if f.parent.name not in {f"era={(march[0] + k) // history.ERA_SLABS}" for k in (-1, 0, 1)}]
    for f in others:  # a file that is read fails
        f.write_bytes(b"none")
    c = frame(spark, [(2000, 3, "t", text, None, "f", "2025-03-10T00:00:00Z")])
    assert len(others) >= 4 and {tuple(r) for r in kept.check(c, times(c), "again").collect()} == {(i, 2000) for i in range(2, 30, 6)}


def test_empty_batches(spark):
    items, _ = corpus(4, 20, 4)
    a, b = frame(spark, items), frame(spark, [])
    assert history.History.build(a, times(a)).check(b, times(b)).count() == 0


def test_whole_operator(spark):
    items, incoming = corpus(5, 40, 30)
    sources = spark.createDataFrame([("s", None)], "id string, time_zone string")
    for together in (1, 3):
        got = {tuple(r) for r in history.repeats(frame(spark, items).drop("batch_id"), frame(spark, incoming), sources, together).collect()}
        assert got == brute(items, incoming)
