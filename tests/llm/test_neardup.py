import itertools
import random
import time

import numpy as np

from siftwell.llm import neardup
from siftwell.llm.likeness import gram_sets, words_of

SCHEMA = "id long, title string, summary string, rep long, key string, part int, words string"
VOCABULARY = [f"w{i}" for i in range(400)]


def items(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "clash", 1, "clash") for i, t, s in rows], SCHEMA)


def edited(rng, words, share):
    words = list(words)
    for _ in range(int(len(words) * share)):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [rng.choice(VOCABULARY)], [words[k], rng.choice(VOCABULARY)]])
    return words


def corpus(seed=1, stories=40, copies=4):
    rng, rows, i = random.Random(seed), [], 0
    for _ in range(stories):
        base = [rng.choice(VOCABULARY) for _ in range(60)]
        for _ in range(rng.randrange(1, copies)):
            words = edited(rng, base, rng.choice([0, 0.03, 0.08, 0.3]))
            rows.append((i, " ".join(words[:8]), " ".join(words[8:])))
            i += 1
    return rows


def likeness(a, b):
    x, y = (set(zip(w, w[1:], strict=False)) for w in (a, b))
    return len(x & y) / len(x | y)


def brute(rows):
    words = {i: w for i, t, s in rows if (w := words_of(t, s)) is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(words), 2) if likeness(words[a], words[b]) >= 0.5}


def test_pairs_against_brute_force(spark):
    rows = corpus()
    rows += [(1000, None, rows[0][2]), (1001, rows[0][1], None), (1002, "few words", "only three words"), (1003, "", " ".join(["same"] * 30)), (1004, "", " ".join(["same"] * 30)), (0, *rows[0][1:])]
    got = [tuple(r) for r in neardup.pairs(items(spark, rows)).collect()]
    want = brute({r[0]: r for r in rows}.values())
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_hot_block_is_split_and_keeps_all(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.choice(VOCABULARY) for _ in range(60)]
    rows = [(i, "", " ".join(edited(rng, base, 0.04))) for i in range(60)] + corpus(3, 10)[:10]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 12)
    assert {tuple(r) for r in neardup.pairs(items(spark, rows)).collect()} == brute(rows)


def test_copies_are_one_class(spark):
    text = " ".join(VOCABULARY[:30])
    rows = [(i, "t", text) for i in range(20)]
    members, links = neardup.links(items(spark, rows))
    assert members.count() == 20 and {r["rep"] for r in members.collect()} == {0} and links.count() == 0
    assert neardup.pairs(items(spark, rows)).count() == 190


def test_groups_are_the_connected_parts_of_the_pairs(spark):
    rows = corpus(5)
    rng = random.Random(6)
    chain = [[rng.choice(VOCABULARY) for _ in range(60)]]
    for k in range(7):  # neighbours are alike, the ends aren't
        chain.append([*chain[-1][:k * 8], *(rng.choice(VOCABULARY) for _ in range(8)), *chain[-1][k * 8 + 8 :]])
    rows += [(2000 - k, "", " ".join(w)) for k, w in enumerate(chain)]
    text = " ".join(VOCABULARY[:30])
    rows += [(3000 + k, "t", text) for k in range(3)] + [(4000, "few words", "only three words"), (4001, "t", None), (0, *rows[0][1:])]
    want = brute({r[0]: r for r in rows}.values())
    part = {i: i for pair in want for i in pair}
    for _ in part:
        for a, b in want:
            part[a] = part[b] = min(part[a], part[b])
    got = [tuple(r) for r in neardup.groups(items(spark, rows)).collect()]
    assert len(got) == len(set(got)) and dict(got) == part and (1993, 2000) not in want and part[1993] == part[2000] == 1993 and part[3002] == 3000
    assert neardup.groups(items(spark, rows)).columns == ["id", "group"] and neardup.groups(items(spark, []).limit(0)).count() == 0


def test_empty(spark):
    assert neardup.pairs(items(spark, []).limit(0)).count() == 0


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(4)
    for budget in (0, 20, 100):
        base = rng.integers(0, 2**63, (3, 4), dtype="uint64")
        rows = np.concatenate([np.repeat(base, 40, 0) ^ (rng.integers(0, 2**63, (120, 4), dtype="uint64") & rng.integers(0, 2**63, (120, 4), dtype="uint64") & rng.integers(0, 2**63, (120, 4), dtype="uint64")), base, base])
        block = np.sort(rng.integers(0, 2, len(rows)))
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0], block))
        rows, block = rows[order], block[order]
        starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        bits = [np.ascontiguousarray(rows[:, k]) for k in range(4)]
        want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if block[i] == block[j] and sum(int(a[i] ^ a[j]).bit_count() for a in bits) <= budget}
        got = [(min(i, j), max(i, j)) for x, y in neardup.trie_pairs(starts, bits, budget=budget) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_unrelated_rows_of_a_large_block_cost_little():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 2**63, (5000, 4), dtype="uint64")
    rows[1::50] = rows[::50] ^ np.uint64(1)  # near ones among them
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    bits = [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    began = time.process_time()
    got = {(min(i, j), max(i, j)) for x, y in neardup.trie_pairs(np.array([0, 5000]), bits, budget=60) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert time.process_time() - began < 1.5  # followed bit by bit, 12.5 million pairs took over 5 s
    want = {(i, i + 1 + int(j)) for i in range(4999) for j in np.flatnonzero(sum(np.bitwise_count(w[i] ^ w[i + 1 :]).astype(int) for w in bits) <= 60)}
    assert got == want and len(want) >= 100


def test_pairs_of_two_sides_in_large_nodes(monkeypatch):
    rng = np.random.default_rng(7)
    rows = np.repeat(rng.integers(0, 2**63, (20, 4), dtype="uint64"), 8, 0) ^ (np.uint64(1) << rng.integers(0, 64, (160, 4), dtype="uint64"))
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    side, bits = rng.integers(0, 2, 160), [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    want = {(i, j) for i, j in itertools.combinations(range(160), 2) if side[i] != side[j] and sum(int(w[i] ^ w[j]).bit_count() for w in bits) <= 40}
    for tiled, tile in ((1, 7), (600, 256), (10**9, 256)):
        monkeypatch.setattr(neardup, "_TILED", tiled)
        monkeypatch.setattr(neardup, "_TILE", tile)
        got = [(min(i, j), max(i, j)) for x, y in neardup.trie_pairs(np.array([0, 160]), bits, side, 40) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_bands_in_rounds_meet_alike(spark, monkeypatch):
    rows, got = corpus(8, 15), []
    for n in (1, 8):
        monkeypatch.setattr(neardup, "ROUNDS", n)
        got.append({tuple(r) for r in neardup.pairs(items(spark, rows)).collect()})
    assert got[0] == got[1] == brute(rows)


def test_gram_sets():
    rows, offsets, grams = gram_sets([["a", "b", "a", "b"], None, ["x"], ["a", "b"]])
    assert rows.tolist() == [0, 3] and np.diff(offsets).tolist() == [2, 1] and grams[offsets[1]] in grams[: offsets[1]]
    assert len(gram_sets([None, []])[0]) == 0


def test_exact_links_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = []
    for k in range(25):
        base = [rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz") for _ in range(40)]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, 14)):
                w[rng.randrange(len(w))] = rng.choice("xyz") * 2
            rows.append((len(rows), "t", " ".join(w)))
    rows.append((500, "t", rows[0][2]))
    df = spark.createDataFrame(rows, "id long, title string, summary string")
    sets = {}
    for i, t, s in rows:
        w = [t, *s.split()]
        sets[i] = set(zip(w, w[1:], strict=False))
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {tuple(r) for r in neardup.pairs(df, exact=True).collect()} == want and len(want) > 20
