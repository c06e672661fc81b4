"""Long exact spans shared between documents, found through windows that are counted before they are grouped.

Windows are runs of GRAM characters, chosen by their content: the one of least hash in every row of LEAST - GRAM + 1
neighbours. Two texts that share a run of LEAST characters choose the same window in it. Windows are dealt to ranges of their hash, as
many as keep a range at RANGE_WINDOWS on average, and each range counts the windows of all partitions in a count-min sketch of its own, as wide as
it has windows: the sketches of the partitions' parts are merged there and only ever count too much, so a second pass over the range keeps
exactly those windows that may repeat and loses none; these are grouped exactly. Before they are sent, the windows of a partition are put together in
chunks: a window that several documents of a chunk hold is known to repeat and passes by the ranges, which get it once. So no range grows with
a window that half the corpus holds, and nothing is merged on the driver.

Windows that do repeat are carried to their texts, pairs of documents are compared there character by character, and runs are extended to their full
length. That costs a comparison a pair. Where a window has more than HOT occurrences, it is cheaper to give all runs of LEAST characters
around each occurrence by hash, so that documents meet where such a run is equal: that costs at most GRAM + 1 rows an occurrence and
decides the same pairs exactly. Runs that the same documents hold are one class, with their number, and only one run of a class gives its pairs.

Defined results: null, empty and shorter texts share nothing; a document doesn't share with itself; line ends, emoji and
other characters are compared as they are; equal texts share all of themselves; periodic texts are compared once a shift; very long texts are cut into overlapping
pieces for hashing only; repeated rows of a doc_id are one document; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import cut

LEAST, GRAM = 200, 100
#: Occurrences of a window from which its runs are hashed instead of compared pair by pair; both ways give the same.
HOT = 32
PIECE = 1 << 19
#: Windows of a range on average, windows that are put together before they are sent, and rows of a sketch.
RANGE_WINDOWS, CHUNK_WINDOWS, ROWS = 1 << 16, 1 << 18, 2

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROW = LEAST - GRAM + 1
_WINDOW = np.dtype([("h", "uint64"), ("doc", "int64"), ("pos", "int32"), ("n", "uint8")])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


_UP, _DOWN = None, None


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the chosen windows of texts of at most 2 * PIECE characters in all."""
    global _UP, _DOWN
    sizes = np.array([len(t) for t in texts])
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    n = len(a) - GRAM + 1
    if n < _ROW:
        return np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "uint64")
    if _UP is None or len(_UP) < len(a):
        _UP, _DOWN = _powers(_P, len(a) + PIECE), _powers(_PINV, len(a) + PIECE)
    with np.errstate(over="ignore"):
        c = np.concatenate([np.zeros(1, "uint64"), np.cumsum((a + np.uint64(1)) * _UP[: len(a)])])
        h = (c[GRAM:] - c[:-GRAM]) * _DOWN[:n]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    low = np.uint64((1 << 20) - 1)
    m = (h & ~low) | np.arange(n, dtype="uint64")
    span = 1
    while span * 2 <= _ROW:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: n - _ROW + 1], m[_ROW - span : _ROW - span + n - _ROW + 1])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    whole = np.zeros(len(m) + 1, "int64")  # rows of windows that lie within one text
    ok = sizes >= LEAST
    np.add.at(whole, begins[ok], 1)
    np.add.at(whole, np.minimum(ends[ok] - LEAST + 1, len(m)), -1)
    at = np.unique(m[np.cumsum(whole[:-1]) > 0] & low).astype("int64")
    which = np.searchsorted(ends, at, "right")
    return which, at - begins[which], h[at]


def _pieces(ids: list, texts: list) -> Iterator[tuple[list, list[int], list[str]]]:
    """Documents, whole or as overlapping pieces, in lots of about PIECE characters: (ids, starts, texts)."""
    docs, starts, held, size = [], [], [], 0
    for i, t in zip(ids, texts, strict=True):
        if not t or len(t) < LEAST:
            continue
        for s in range(0, max(1, len(t) - LEAST + 1), PIECE - LEAST + 1):
            piece = t[s : s + PIECE]
            if size + len(piece) > 2 * PIECE - 1:
                yield docs, starts, held
                docs, starts, held, size = [], [], [], 0
            docs.append(i), starts.append(s), held.append(piece)
            size += len(piece)
    if held:
        yield docs, starts, held


def _windows(ids: list, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, position, hash) of all chosen windows."""
    for docs, starts, held in _pieces(ids, texts):
        which, pos, h = fingerprints(held)
        yield np.array(docs, "int64")[which], np.array(starts, "int64")[which] + pos, h


def _cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((h * m) >> np.uint64(64 - width.bit_length() + 1)).astype("int64") for m in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))]


def _dealt(bits: int):
    """(part, rows): the windows of a partition, chunk by chunk, dealt to 2 ** bits ranges of their hash; parts below 0 are of windows
    that several documents of a chunk hold. Windows of a part are records of _WINDOW: how much a window counts for is told once a chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sure = -1 - ((context.partitionId() if context else 0) << 24)
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal sure, held, size
            doc, pos, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            w = np.zeros(len(h), _WINDOW)
            w["h"], w["doc"], w["pos"] = h[order], doc[order], pos[order]
            begins = np.concatenate([[0], np.flatnonzero(w["h"][1:] != w["h"][:-1]) + 1])
            several = np.minimum.reduceat(w["doc"], begins) != np.maximum.reduceat(w["doc"], begins)
            w["n"][begins] = np.where(several, 2, 1)
            own = np.repeat(several, np.diff([*begins, len(w)]))
            told = w[begins[several]]
            told["pos"] = -1
            rest = np.concatenate([w[~own], told])
            rest = rest[np.argsort(rest["h"], kind="stable")]
            part = (rest["h"] >> np.uint64(64 - bits)).astype("int64") if bits else np.zeros(len(rest), "int64")
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(rest)]])
            parts, data = part[cuts[:-1]].tolist(), [rest[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if own.any():
                parts, data, sure = [*parts, sure], [*data, w[own].tobytes()], sure - 1
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], names=["part", "rows"])

        for b in batches:
            for doc, pos, h in _windows(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(h):
                    held.append((doc, pos, h))
                    size += len(h)
                if size >= CHUNK_WINDOWS:
                    yield chunk()
        if size:
            yield chunk()

    return rows


def _estimated(part: pa.Table) -> pa.Table:
    """(h, doc, pos) of the windows of a part that may repeat, by the merged sketches of its partitions' rows."""
    held = [np.frombuffer(x, _WINDOW) for x in part.column("rows").to_pylist()]
    w = np.concatenate(held)
    if part.column("part")[0].as_py() >= 0:
        width = 1 << max(10, (2 * len(w) - 1).bit_length())
        counts = np.zeros((ROWS, width), "int64")
        for x in held:
            for r, cell in enumerate(_cells(x["h"], width)):
                counts[r] += np.bincount(cell, weights=x["n"], minlength=width).astype("int64")
        least = np.min([counts[r, cell] for r, cell in enumerate(_cells(w["h"], width))], axis=0)
        w = w[(least >= 2) & (w["pos"] >= 0)]
    return pa.table([pa.array(w["h"].view("int64")), pa.array(w["doc"]), pa.array(w["pos"].astype("int64"))], names=["h", "doc", "pos"])


def repeated_windows(documents: DataFrame) -> DataFrame:
    """(h, doc, pos, places): occurrences of the chosen windows that more than one document holds, and how many there are."""
    texts = documents.where(F.length("text") >= LEAST).where("doc_id is not null").select("doc_id", "text")
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bits = max(0, (2 * chars // _ROW // RANGE_WINDOWS).bit_length())
    found = cut(texts.mapInArrow(_dealt(bits), "part long, rows binary").groupBy("part").applyInArrow(_estimated, "h long, doc long, pos long"))
    groups = found.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("places")).where("a < b").select("h", "places")
    return cut(found.join(groups, "h").distinct())


def _texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("doc"), "text").where("text is not null").join(ids.distinct(), "doc", "left_semi").dropDuplicates(["doc"])


def _extend(a: str, b: str, i: int, j: int) -> tuple[int, int, int]:
    """Starts and length of the longest run through a[i] and b[j], which are equal there for GRAM characters."""
    back, most, step = 0, min(i, j), 64
    while back < most:
        step = min(step, most - back)
        if a[i - back - step : i - back] == b[j - back - step : j - back]:
            back += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    on, most, step = GRAM, min(len(a) - i, len(b) - j), 64
    while on < most:
        step = min(step, most - on)
        if a[i + on : i + on + step] == b[j + on : j + on + step]:
            on += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return i - back, j - back, back + on


def _progressions(pos: list[int]) -> list[tuple[int, int, int]]:
    """Positions as (start, step, count): rows of three or more at one distance, as periodic text has them, and single ones."""
    pos, out, k = sorted(set(pos)), [], 0
    while k < len(pos):
        n = k + 1
        while n + 1 < len(pos) and pos[n + 1] - pos[n] == pos[k + 1] - pos[k]:
            n += 1
        if n < len(pos) and n - k >= 2:
            out.append((pos[k], pos[k + 1] - pos[k], n - k + 1))
            k = n + 1
        else:
            out.append((pos[k], 0, 1))
            k += 1
    return out


def _starts(pos_a: list[int], pos_b: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of positions, one on each diagonal of a pair of periodic stretches, all of the others.

    Windows at one distance of at most GRAM cover their stretch, which then is periodic; between windows further apart the text is free.
    """
    for a, d, m in _progressions(pos_a):
        for b, e, n in _progressions(pos_b):
            if 0 < d == e <= GRAM:
                yield from ((a + d * k, b) for k in range(m))
                yield from ((a, b + d * k) for k in range(1, n))
            else:
                yield from ((a + d * i, b + e * j) for i in range(m) for j in range(n))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_a", "doc_b", "start_a", "start_b", "length"]
    for p in batches:
        out = set()
        for x, y, a, b, at in zip(p.doc_a, p.doc_b, p.text_a, p.text_b, p["at"], strict=True):
            done: dict[int, list[tuple[int, int]]] = {}
            for r in at:
                for i, j in _starts(list(r["pos_a"]), list(r["pos_b"])):
                    if any(s <= i < e for s, e in done.get(i - j, ())) or a[i : i + GRAM] != b[j : j + GRAM]:
                        continue
                    s, t, n = _extend(a, b, i, j)
                    done.setdefault(i - j, []).append((s, s + n))
                    if n >= LEAST:
                        out.add((x, y, s, t, n))
        yield pd.DataFrame(list(out), columns=names)


def _around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(run, doc, start): all runs of LEAST characters that hold a given window, by hash."""
    for p in batches:
        out = []
        for doc, text, at in zip(p.doc, p.text, p["at"], strict=True):
            starts = sorted({s for i in at for s in range(max(0, i + GRAM - LEAST), min(i, len(text) - LEAST) + 1)})
            out += [(xxhash.xxh3_128_digest(text[s : s + LEAST].encode("utf-8", "surrogatepass")), doc, s) for s in starts]
        yield pd.DataFrame(out, columns=["run", "doc", "start"])


def shared_runs(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, hot): maximal runs (doc_a, doc_b, start_a, start_b, length) of pairs, and for windows of more than HOT occurrences
    the runs of LEAST characters (run, doc, start) that more than one document holds."""
    windows = repeated_windows(documents)
    few, many = windows.where(F.col("places") <= HOT), windows.where(F.col("places") > HOT)
    held = few.groupBy("h", "doc").agg(F.collect_list("pos").alias("pos"))  # the places of a window in one document
    a, b = (held.select("h", F.col("doc").alias(f"doc_{x}"), F.col("pos").alias(f"pos_{x}")) for x in "ab")
    meet = a.join(b, "h").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.collect_list(F.struct("pos_a", "pos_b")).alias("at"))
    texts = cut(_texts_of(documents, few.select("doc")))
    meet = meet.join(texts.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(texts.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
    pairs = meet.mapInPandas(_runs, "doc_a long, doc_b long, start_a long, start_b long, length long")
    if many.isEmpty():
        return pairs, documents.sparkSession.createDataFrame([], "run binary, doc long, start long")
    at = many.groupBy("doc").agg(F.collect_set("pos").alias("at"))
    runs = _texts_of(documents, many.select("doc")).join(at, "doc").mapInPandas(_around, "run binary, doc long, start long")
    runs = cut(runs)
    held = runs.groupBy("run").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("run")
    return pairs, runs.join(held, "run")


def run_classes(hot: DataFrame) -> DataFrame:
    """(run, docs): one run of each set of documents that hold the same runs, and how many these are."""
    held = hot.select("run", "doc").distinct().groupBy("run").agg(F.count("*").alias("docs"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    return held.groupBy("docs", "x", "y").agg(F.min("run").alias("run")).select("run", "docs")


def sharing(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b) of documents that share a run of LEAST characters."""
    pairs, hot = shared_runs(documents)
    some = hot.select("run", "doc").distinct().join(run_classes(hot).select("run"), "run", "left_semi")
    a, b = (some.select("run", F.col("doc").alias(f"doc_{x}")) for x in "ab")
    return pairs.select("doc_a", "doc_b").unionByName(a.join(b, "run").where("doc_a < doc_b").select("doc_a", "doc_b")).distinct()


def coverage(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_part): how much of each document stands in another one as well."""
    pairs, hot = shared_runs(documents)
    runs = pairs.select(F.col("doc_a").alias("doc"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("stop"))
    runs = runs.unionByName(pairs.select(F.col("doc_b").alias("doc"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("length")).alias("stop")))
    runs = runs.unionByName(hot.select("doc", "start", (F.col("start") + LEAST).alias("stop"))).distinct()
    ordered = runs.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("r"))  # the runs of one document
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate("r", zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end")))
    shared = ordered.select(F.col("doc").alias("doc_id"), total["n"].alias("shared_chars"))
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).dropDuplicates(["doc_id"])
    rows = sizes.join(shared, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return rows.withColumn("shared_part", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
