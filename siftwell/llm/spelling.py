"""Texts that look the same brought to one spelling, by tries over the corpus's own vocabulary.

The vocabulary is every word of the corpus written plainly: composed, in one script, without invisible, wide or
borrowed characters. Each other word is run through a trie of the vocabulary by a weighted edit automaton whose edits
cost nothing between look-alikes and at ignorable characters, and more than the budget otherwise; of the spellings
it reaches, the commonest is its canonical one. Words that reach none are spelled by the table of `shown`, as is
everything between words (blanks, hyphens, wide signs).

The work is spread by a key that all spellings of a word share (its first base letters and its length), so that a
word meets its vocabulary in one partition, and each partition builds the trie of one key at a time. Only distinct
words are shuffled; only texts with such words are rewritten.

Defined results: null texts stay null and pair with nothing; texts that show nothing (empty, blank, invisible) are '' and pair with
nothing; repeated rows of one id are one row; ties between spellings go to the smaller one; whole texts are treated;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shown import LOOKALIKES, canonical, replacements
from siftwell.operators.joins import lookup
from siftwell.session import cut

#: What the automaton pays: nothing at ignorable characters, at letters that look alike and for the letters that a wide form or a ligature
#: stands for; a full edit for everything else. Within the budget only spellings that look the same are reached.
IGNORABLE_COST, ALIKE_COST, EDIT_COST = 0.0, 0.0, 1.0
BUDGET = 0.0

#: A word as written: letters, digits, marks and invisible characters in a row; Han characters stand alone.
_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
_RAW = re.compile(rf"(?:[^\W_{_HAN}]|[̀-ͯ­͏​-‏⁠-⁤﻿︀-️])+")
_ASCII = re.compile(r"[A-Za-z0-9]+")


@lru_cache(maxsize=1)
def _same() -> dict[str, tuple[str, ...]]:
    """For each base character, the vocabulary's characters that look like it."""
    groups = defaultdict(set)
    for c, latin in LOOKALIKES.items():
        groups[latin] |= {c, latin}
    return {c: tuple(sorted(g)) for g in groups.values() for c in g}


def units(word: str) -> str:
    """The word decomposed, with width forms and ligatures spelled out and ignorable characters gone; look-alikes are left to the automaton."""
    table = replacements()
    out = []
    for c in unicodedata.normalize("NFD", word):
        to = table.get(ord(c))
        out.append(c if to is None or c in LOOKALIKES else to)
    return "".join(out)


def plain(word: str) -> bool:
    """Whether a word is written as a vocabulary word: composed Latin, or composed Cyrillic that isn't all look-alikes."""
    if word.isascii():
        return word.isalnum()
    if unicodedata.normalize("NFC", word) != word:
        return False
    letters = [c for c in word if not c.isdigit()]
    if all("a" <= c.lower() <= "z" or "À" <= c <= "ɏ" for c in letters):
        return units(word) == unicodedata.normalize("NFD", word)
    return all("Ѐ" <= c <= "ӿ" for c in letters) and any(c not in LOOKALIKES for c in unicodedata.normalize("NFD", word) if c.isalpha())


def meeting_key(word: str) -> str:
    """Equal for all spellings that look alike."""
    base = "".join(LOOKALIKES.get(c, c) for c in units(word) if not unicodedata.combining(c))
    return f"{len(base)}:{base[:4]}"


class Trie:
    """A trie of vocabulary words over their decomposed characters."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (count, word)

    def nearest(self, word: str, budget: float = BUDGET) -> str | None:
        """The cheapest spelling within the budget, then the commonest, then the smallest.

        The automaton's states are (node, cost). It reads the word as it is written: an ignorable character leaves it where it is, a wide form or a
        ligature follows the letters that it stands for, an equal letter or one that looks alike its edge; a substitution, an extra or a missing
        character costs EDIT_COST. States beyond the budget are dropped.
        """
        same, table = _same(), replacements()
        states: dict[int, tuple[dict, float]] = {}

        def put(into: dict, node: dict, cost: float) -> None:
            if cost <= budget and (id(node) not in into or into[id(node)][1] > cost):
                into[id(node)] = (node, cost)
                for c, child in node.items():
                    if c:
                        put(into, child, cost + EDIT_COST)  # a character that the word lacks

        put(states, self.root, 0.0)
        for written in unicodedata.normalize("NFD", word):
            to = table.get(ord(written))
            if to == "":
                passed = [(node, cost + IGNORABLE_COST) for node, cost in states.values()]
                states = {}
                for node, cost in passed:
                    put(states, node, cost)
                continue
            for c in written if to is None or written in LOOKALIKES else to:
                after: dict[int, tuple[dict, float]] = {}
                free = same.get(c, (c,))
                for node, cost in states.values():
                    for x in free:
                        if x in node:
                            put(after, node[x], cost + (0.0 if x == c else ALIKE_COST))
                    if cost + EDIT_COST <= budget:
                        put(after, node, cost + EDIT_COST)
                        for x, child in node.items():
                            if x and x not in free:
                                put(after, child, cost + EDIT_COST)
                states = after
            if not states:
                return None
        ends = [(cost, -node[""][0], node[""][1]) for node, cost in states.values() if "" in node]
        return min(ends)[2] if ends else None


def _long(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns))
    return records.where("id is not null").select("id", F.explode(fields).alias("x")).select("id", "x.field", "x.text").where("text is not null")


@lru_cache(maxsize=200_000)
def _kind(word: str) -> bool:
    return plain(word)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a batch: vocabulary words with their counts (no id), and the odd words of each text."""
    for b in batches:
        ids, fields, texts = (b.column(i).to_pylist() for i in range(3))
        known: Counter[str] = Counter()
        odd = []
        for i, f, t in zip(ids, fields, texts, strict=True):
            if t.isascii():
                known.update(_ASCII.findall(t))
                continue
            for w, n in Counter(_RAW.findall(t)).items():
                if w.isascii() or _kind(w):
                    known[w] += n
                else:
                    odd.append((i, f, w))
        words = [w for w in known if not w.isdigit()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(words) + [x[k] for x in odd], t) if k < 2 else pa.array(words + [x[2] for x in odd], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            + [pa.array([known[w] for w in words] + [0] * len(odd), pa.int64())],
            names=["id", "field", "word", "n"],
        )


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        yield pd.DataFrame({"key": p.word.map(meeting_key), "word": p.word, "n": p["n"]})


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, a key's vocabulary (n > 0) before its other words."""
    key, trie = None, Trie()
    for p in batches:
        out = []
        for k, w, n in zip(p.key, p.word, p.n, strict=True):
            if k != key:
                key, trie = k, Trie()
            if n:
                trie.add(w, n)
            else:
                out.append((w, trie.nearest(w) or canonical(w)))
        yield pd.DataFrame(out, columns=["word", "spelling"])


def spellings(scan: DataFrame) -> DataFrame:
    """(word, spelling) for each distinct odd word of a scan, by the vocabulary of all its texts."""
    both = scan.groupBy("word").agg(F.sum("n").alias("n"))  # odd words have the count 0
    keyed = both.mapInPandas(_keyed, "key string, word string, n long")
    meets = keyed.where("n = 0").select("key").distinct()
    return keyed.join(meets, "key", "left_semi").repartition("key").sortWithinPartitions("key", F.desc("n")).mapInPandas(_spell, "word string, spelling string")


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = []
        for t, words, to in zip(p.text, p.words, p.spellings, strict=True):
            if words is not None and len(words):
                t = _RAW.sub(lambda m, to=dict(zip(words, to, strict=True)): to.get(m[0], m[0]), t)
            # what stands between words by the table; the canonical words are left as they are
            out.append(" ".join("".join(x if i % 2 else _between(x) for i, x in enumerate(re.split(f"({_RAW.pattern})", t))).split()))
        yield pd.DataFrame({"id": p.id, "field": p.field, "text": p.text, "canonical": out})


def _between(x: str) -> str:
    return x if x.isascii() and x.isprintable() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", x).translate(replacements()))


def canonical_texts(records: DataFrame, columns: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """(id, field, text, canonical): the stored and the canonical form of each text that isn't null."""
    texts = _long(records, columns)
    odd_text = F.col("text").rlike(r"[^\x20-\x7e]")
    easy = texts.where(~odd_text).select("id", "field", "text", F.trim(F.regexp_replace("text", " +", " ")).alias("canonical"))
    hard = texts.where(odd_text)
    scan = cut(texts.mapInArrow(_scan, "id long, field string, word string, n long"))
    words = scan.where("n = 0").select("id", "field", "word")
    to = cut(spellings(scan))
    maps = lookup(words, to, "word").groupBy("id", "field").agg(F.collect_list(F.struct("word", "spelling")).alias("m"))  # the words of one text
    rewritten = (
        hard.join(maps, ["id", "field"], "left")
        .select("id", "field", "text", F.col("m.word").alias("words"), F.col("m.spelling").alias("spellings"))
        .mapInPandas(_rewrite, "id long, field string, text string, canonical string")
    )
    return easy.unionByName(rewritten)


def same_looking(records: DataFrame, columns: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """(field, id_a, id_b): records whose texts look equal, aren't empty and are stored differently."""
    forms = canonical_texts(records, columns).where("canonical != ''")
    forms = forms.select("id", "field", *(F.struct(F.xxhash64(c), F.hash(c)).alias(to) for c, to in (("canonical", "look"), ("text", "stored")))).distinct()
    varied = forms.groupBy("field", "look").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a != b").select("field", "look")
    forms = forms.join(varied, ["field", "look"], "left_semi")
    a, b = (forms.select("field", "look", F.col("id").alias(f"id_{x}"), F.col("stored").alias(f"stored_{x}")) for x in "ab")
    return a.join(b, ["field", "look"]).where("id_a < id_b and stored_a != stored_b").select("field", "id_a", "id_b").distinct()


def look_classes(records: DataFrame, columns: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """(field, canonical, texts, spellings, first): each text that several records show, how many do, in how many spellings, and the smallest id."""
    forms = canonical_texts(records, columns).where("canonical != ''").select("field", "canonical", "id", F.xxhash64("text").alias("stored")).distinct()
    spelt = forms.groupBy("field", "canonical", "stored").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return spelt.groupBy("field", "canonical").agg(F.sum("n").alias("texts"), F.count("*").alias("spellings"), F.min("id").alias("first")).where("texts > 1")
