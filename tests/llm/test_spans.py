import itertools
import random

from siftwell.llm import spans

SCHEMA = "doc_id long, text string, doc string, pos string, h string, run string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, *["clash"] * 4) for i, t in docs], SCHEMA)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé机🤖\n") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))[: k * 5]
    docs = [(i, text(rng.choice([20, 150, 300]))) for i in range(n)]
    for size in (199, 200, 201, 350, 600):
        for _ in range(2):
            piece = (text(300) * 2)[:size]
            for i in rng.sample(range(n), 3):
                t = docs[i][1]
                k = rng.randrange(len(t) + 1)
                docs[i] = (i, t[:k] + rng.choice("#%") + piece + rng.choice("@!") + t[k:])
    return docs


def brute(docs):
    runs = {}
    for i, t in docs:
        for s in range(len(t or "") - 199):
            runs.setdefault(t[s : s + 200], {}).setdefault(i, []).append(s)
    found, cover = set(), {i: set() for i, _ in docs}
    for held in runs.values():
        if len(held) > 1:
            found |= set(itertools.combinations(sorted(held), 2))
            for i, starts in held.items():
                for s in starts:
                    cover[i].update(range(s, s + 200))
    return found, {i: len(c) for i, c in cover.items()}


def check(spark, docs):
    found, cover = brute({i: (i, t) for i, t in docs}.values())
    got = [tuple(r) for r in spans.sharing(frame(spark, docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == found
    assert {r["doc_id"]: r["shared_chars"] for r in spans.coverage(frame(spark, docs)).collect()} == cover
    return found


def test_against_brute_force(spark):
    docs = corpus()
    docs += [(1000, None), (1001, ""), (1002, "x" * 199), (1003, "ab" * 300), (1004, "ab" * 250), (1005, docs[0][1]), docs[3], (1006, "q" * 200), (1007, "q" * 5000)]
    assert len(check(spark, docs)) > 10


def test_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 3)
    rng = random.Random(3)
    notice = "".join(rng.choice("abcdefgh ") for _ in range(230))
    short = notice[:150]
    docs = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 80))) + (notice if i % 2 else short) + "".join(rng.choice("uvw") for _ in range(120))) for i in range(16)]
    assert len(check(spark, docs)) == 28


def test_a_notice_in_very_many_documents(spark):
    rng = random.Random(5)
    notice = "".join(rng.choice("abcdefgh ") for _ in range(420))
    docs = [(i, f"{i * 7919} " + (notice if i % 10 else notice[:150]) + f" {i * 104729}") for i in range(1200)]
    pairs, hot = spans.shared_runs(frame(spark, docs))
    assert pairs.count() < 1000  # of windows at the edges that few documents share
    classes = spans.run_classes(hot).collect()
    assert [r["docs"] for r in classes].count(1080) == 1 and sum(r["docs"] ** 2 for r in classes) < 2 * 1080**2  # next to no pair is given twice
    assert spans.sharing(frame(spark, docs)).count() == 1080 * 1079 // 2
    covered = {r["doc_id"]: r["shared_chars"] for r in spans.coverage(frame(spark, docs)).collect()}
    assert all((covered[i] >= 420) == bool(i % 10) for i in range(1200)) and covered[10] == 0


def test_sketches_lose_no_repeated_window(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(spans, "CHUNK_WINDOWS", 50)
    rng = random.Random(2)
    shared = ["".join(rng.choice("abcdef") for _ in range(400)) for _ in range(5)]
    texts = ["".join(rng.choice("uvwxyz") for _ in range(rng.randrange(200, 900))) + rng.choice(shared) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    every = {(int(h), int(d)) for doc, pos, hashes in spans._windows(list(range(60)), texts) for d, h in zip(doc, hashes.view("int64"), strict=True)}
    docs = {}
    for h, d in every:
        docs.setdefault(h, set()).add(d)
    for bits in (0, 3):
        dealt = pa.Table.from_batches(spans._dealt(bits)(iter([batch])))
        parts = np.unique(dealt.column("part").to_numpy())
        out = [spans._estimated(dealt.filter(pa.array(dealt.column("part").to_numpy() == k))) for k in parts]
        got = {(h, d) for t in out for h, d in zip(t.column("h").to_pylist(), t.column("doc").to_pylist(), strict=True)}
        assert got <= every and all((h, d) in got for h, ds in docs.items() if len(ds) > 1 for d in ds)
        assert len(got) < 0.6 * len(every) and (parts < 0).any()


def test_very_long_texts_are_cut_for_hashing_only(monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcd") for _ in range(6000))
    docs = {1: long, 2: "z" + long[700:4000], 3: "short"}
    chosen = {}
    for piece in (1 << 19, 1000):
        monkeypatch.setattr(spans, "PIECE", piece)
        found = [(int(d), int(p), int(h)) for doc, pos, hashes in spans._windows(list(docs), list(docs.values())) for d, p, h in zip(doc, pos, hashes, strict=True)]
        chosen[piece] = set(found)
        for start in range(700, 3800, 37):  # every row of LEAST characters holds a window that both documents chose
            inside = {(h, p - start) for d, p, h in found if d == 1 and start <= p <= start + spans.LEAST - spans.GRAM}
            other = {(h, p - (start - 699)) for d, p, h in found if d == 2 and start - 699 <= p <= start - 699 + spans.LEAST - spans.GRAM}
            assert inside & other
    assert chosen[1000] >= chosen[1 << 19]


def test_long_periodic_texts(spark):
    docs = [(1, "x" * 6000), (2, "y" + "x" * 3000 + "z"), (3, "ab" * 2000), (4, "q" + "ba" * 150), (5, "x" * 199)]
    check(spark, docs)


def test_a_notice_at_equal_distances_beyond_a_window(spark):
    rng, docs = random.Random(11), []
    free = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for k in range(24):  # the second of three notices stands in a longer shared run, the first and third don't
        notice, left, right = free(150), free(30), free(30)
        docs += [(2 * k + x, notice + free(320) + left + notice + right + free(320) + notice + free(90)) for x in range(2)]
    assert len(check(spark, docs)) == 24


def test_empty(spark):
    df = frame(spark, [(1, "x")])
    assert spans.sharing(df.limit(0)).count() == 0 and spans.coverage(df.limit(0)).count() == 0 and spans.coverage(df).first()["shared_part"] == 0.0
