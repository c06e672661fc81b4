import itertools
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import spelling
from siftwell.llm.shown import LOOKALIKES, canonical, shown

SCHEMA = "id long, title string, summary string, field string, text string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], SCHEMA)


def test_what_looks_alike():
    same = ["Robot café-fi ①", "Rοbоt café‐ﬁ ①", "​Ｒobot  café‑f­i ①﻿"]
    assert len({canonical(x) for x in same}) == 1
    different = ["Robot", "robot", "Robôt", "Robot²", "Robot2", "Robot①", "Robot1", "Robot.", "“Robot”"]
    assert len({canonical(x) for x in different}) == len(different)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_canonical_is_stable(text):
    assert canonical(canonical(text)) == canonical(text)
    assert canonical(unicodedata.normalize("NFD", text)) == canonical(text)


def test_automaton():
    trie = spelling.Trie()
    for w, n in (("проект", 3), ("robot", 5), ("robots", 1), ("été", 2)):
        trie.add(w, n)
    assert trie.nearest("прοект") == "проект" and trie.nearest("rоb​ot") == "robot" and trie.nearest("été") == "été"
    assert trie.nearest("ｒobot") == "robot" and trie.nearest("rabot") is None and trie.nearest("") is None
    assert trie.nearest("rabot", budget=1) == "robot" and trie.nearest("rbot", budget=1) == "robot" and trie.nearest("rooobot", budget=1) is None


def scrambled(rng, text):
    back = {}
    for k, v in LOOKALIKES.items():
        back.setdefault(v, []).append(k)
    out = []
    for c in text:
        r = rng.random()
        if c in back and r < 0.15:
            out.append(rng.choice(back[c]))
        elif c == " " and r < 0.3:
            out.append(rng.choice([" ", "　", "  ", " "]))
        elif r < 0.05:
            out.append(c + rng.choice(["​", "­", "⁠"]))
        elif c.isascii() and c.isalpha() and r < 0.1:
            out.append(chr(ord(c) + 0xFEE0))
        else:
            out.append(c)
    return unicodedata.normalize("NFD", "".join(out)) if rng.random() < 0.3 else "".join(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["Robot labs test café sensors", "Проект робота в лаборатории", "机器人 Lab 测试，完成", "cop сор", "Ω unit μCtl²", "short"]
    rows = [(i, scrambled(rng, rng.choice(base)), scrambled(rng, rng.choice(base))) for i in range(60)]
    rows += [(100, None, ""), (101, "", None), (102, "​", "  "), (103, "x" * 50_000, "ｘ" + "x" * 49_999), (104, "ｘ" + "x" * 49_999, None), (0, rows[0][1], rows[0][2])]
    got = {tuple(r) for r in spelling.same_looking(items(spark, rows)).collect()}
    want = set()
    unique = {r[0]: r for r in rows}.values()
    for field, k in (("title", 1), ("summary", 2)):
        for a, b in itertools.combinations(sorted(unique, key=lambda r: r[0]), 2):
            if a[k] is not None and b[k] is not None and a[k] != b[k] and canonical(a[k]) == canonical(b[k]) != "":
                want.add((field, a[0], b[0]))
    assert got == want and want


def test_canonical_words_come_from_the_corpus(spark):
    rows = [(1, "проект", None), (2, "прοект", None), (3, "rоbot", "robot")]
    got = {(r["id"], r["field"]): r["canonical"] for r in spelling.canonical_texts(items(spark, rows)).collect()}
    assert got[(2, "title")] == "проект" and got[(3, "title")] == "robot"


def test_empty(spark):
    assert spelling.same_looking(items(spark, []).limit(0)).count() == 0


def test_shown_column(spark):
    texts = ["plain  text", " Ｗide x ", None, "", "rοbot", "tab\tnew\nline"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["s"] for r in df.select("i", shown(df.t).alias("s")).orderBy("i").collect()] == [None if t is None else canonical(t) for t in texts]


def test_the_automaton_reads_words_as_they_are_written():
    trie = spelling.Trie()
    for w, n in (("office", 9), ("offense", 3), ("naïve", 4)):
        trie.add(w, n)
    for w in ("o\u200bffice", "oﬃce", "оffiсe", "ｏｆｆｉｃｅ", "o\u00adf\u2060fice", "o\ufb03\u200dce"):
        assert trie.nearest(w) == "office"
    assert trie.nearest("nai\u0308ve") == "naïve" and trie.nearest("naive") is None and trie.nearest("naive", 1.0) == "naïve" and trie.nearest("offize", 1.0) == "office"


def test_classes_of_equal_looks(spark):
    df = spark.createDataFrame([(1, "A\u200bB cd", None), (2, "AB cd", ""), (3, "AB  cd", "x"), (4, "ab cd", "x")], "id long, title string, summary string")
    got = {(r["field"], r["canonical"]): (r["texts"], r["spellings"], r["first"]) for r in spelling.look_classes(df).collect()}
    assert got == {("title", "AB cd"): (3, 3, 1), ("summary", "x"): (2, 1, 3)}
