"""The likeness of records: sets of two-word sequences over the shown title and summary, hashed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shown import WORD, canonical

LEAST_WORDS = 12
LIKE = 0.5


class _Hashes(dict):
    """Hashes of words, kept while they are few enough."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h


_hashes = _Hashes()


def words_of(title: str | None, summary: str | None, least: int = LEAST_WORDS) -> list[str] | None:
    """The words of the shown title and summary in lower case; None where the summary is too short to take part."""
    if summary is None:
        return None
    of_summary = WORD.findall(canonical(summary).lower())
    if len(of_summary) < least:
        return None
    return (WORD.findall(canonical(title).lower()) + of_summary) if title else of_summary


def gram_sets(texts: list[list[str] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, offsets, grams): the rows with words, and the distinct hashed two-word sequences of each."""
    rows = [i for i, w in enumerate(texts) if w is not None and len(w) > 1]
    if not rows:
        return np.empty(0, "int64"), np.zeros(1, "int64"), np.empty(0, "uint64")
    sizes = np.array([len(texts[i]) for i in rows])
    h = np.fromiter((_hashes[w] for i in rows for w in texts[i]), dtype="uint64", count=int(sizes.sum()))
    first = np.ones(len(h), dtype=bool)
    ends = np.cumsum(sizes)
    first[ends - 1] = False
    at = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        g = h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
    owner = np.repeat(np.arange(len(rows)), sizes - 1)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[keep], owner[keep]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
    return np.array(rows), offsets, g


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, titles, summaries = (b.column(i).to_pylist() for i in range(3))
        rows, offsets, g = gram_sets([words_of(t, s) for t, s in zip(titles, summaries, strict=True)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((g >> np.uint64(32)).astype("uint32").view("int32")))
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), lists], names=["id", "grams"])


def gram_arrays(records: DataFrame) -> DataFrame:
    """(id, grams): each taking-part record's sequences as 32-bit hashes, for exact comparison."""
    return records.select("id", "title", "summary").mapInArrow(_gram_rows, "id long, grams array<int>")


def with_likeness(pairs: DataFrame, records: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """The pairs with their exact likeness; both ids must be of records (an id with several rows repeats its pairs)."""
    ids = pairs.select(F.col(a).alias("id")).union(pairs.select(F.col(b).alias("id"))).distinct()
    grams = gram_arrays(records.select("id", "title", "summary").join(ids, "id", "left_semi"))
    x, y = (grams.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{n}")) for n, c in (("x", a), ("y", b)))
    both = F.size(F.array_intersect("grams_x", "grams_y"))
    return pairs.join(x, a).join(y, b).withColumn("likeness", both / (F.size("grams_x") + F.size("grams_y") - both)).drop("grams_x", "grams_y")
