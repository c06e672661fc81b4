"""One UTC instant per record from mixed timestamp formats and zones.

Each record's value is turned into the array of all its valid interpretations; a Viterbi pass over each
source's records in order of arrival then chooses one per record, paying for a switch of format and for
time that runs backwards. The pass is exact and distributed: the records of a source are cut into blocks
of bounded length (a block holds ids of one range, wide enough for BLOCK_IDS records on average, however sparse ids are); each block is reduced to the matrix of
the cheapest costs between the readings of its first and of its last record, the matrices of a source are
chained, which fixes both ends of each block, and each block then fills in its own middle. No task ever
holds more than a block, or one row per block of a source.

Defined results: a null, blank or unreadable value with nothing better beside it gives no row; a day without a
time counts as unreadable; repeated rows of one id give one row; ties go to the reading that convention names
first; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.timestamps import CONVENTION, item_interpretations
from siftwell.session import cut

SWITCH, BACKWARD_DAY, BACKWARD_MOST = 1.0, 0.5, 2.0
BLOCK_IDS = 1 << 16

_CANDIDATES = "id long, source string, block long, us array<long>, fmt array<int>, cost array<double>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, source, block, published, raw, feed, own = (b.column(i).to_pylist() for i in range(7))
        found = [item_interpretations(*x) for x in zip(published, raw, feed, own, strict=True)]
        keep = [i for i, x in enumerate(found) if x]
        offsets = np.concatenate([[0], np.cumsum([len(found[i]) for i in keep])]).astype("int32")
        flat = [y for i in keep for y in found[i]]
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([y[k] for y in flat], t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], t) for x, t in ((ids, pa.int64()), (source, pa.string()), (block, pa.int64()))] + lists, names=["id", "source", "block", "us", "fmt", "cost"])


def candidates(records: DataFrame, sources: DataFrame, convention: float = CONVENTION) -> DataFrame:
    """(id, source, block, us, fmt, cost): the arrays of all readings of each record that has any.

    records: id, source_id, published_at and, if there, metadata_json. sources: id, time_zone. convention: the cost of a breach of convention; below
    what a switch of format and time running backwards cost, context decides slashed dates and clock times shown twice.
    """
    meta = F.col("metadata_json") if "metadata_json" in records.columns else F.lit(None).cast("string")
    zones = sources.groupBy(F.col("id").alias("source_id")).agg(F.max("time_zone").alias("own"))
    rows = records.select("id", "source_id", "published_at", meta.alias("m")).where("id is not null").join(zones, "source_id", "left")
    low, high, n = records.agg(F.min("id"), F.max("id"), F.count("id")).first()
    width = min(1 << 62, max(BLOCK_IDS, (high - low + 1) * BLOCK_IDS // n)) if n else BLOCK_IDS
    rows = rows.select(
        "id", F.coalesce("source_id", F.lit("")).alias("source"), F.floor(F.col("id") / F.lit(width)).cast("long").alias("block"), "published_at",
        F.get_json_object("m", "$.published_raw").alias("raw"), F.get_json_object("m", "$.feed_tz").alias("feed"), "own",
    )
    found = rows.mapInArrow(_read, _CANDIDATES)
    return found if convention == CONVENTION else found.withColumn("cost", F.transform("cost", lambda c: c * F.lit(convention / CONVENTION)))


def _step(before: tuple, after: tuple) -> np.ndarray:
    """Costs from each reading of one record to each of the next, with the latter's own."""
    us0, f0, _ = before
    us1, f1, c1 = after
    back = np.maximum(0, us0[:, None] - us1[None, :]) / 86_400e6
    return (f0[:, None] != f1[None, :]) * SWITCH + np.minimum(BACKWARD_MOST, back * BACKWARD_DAY) + c1[None, :]


def _rows(p: pd.DataFrame) -> list[tuple]:
    p = p.sort_values("id", kind="stable").drop_duplicates("id")
    return [(np.asarray(u, "int64"), np.asarray(f), np.asarray(c, "float64")) for u, f, c in zip(p.us, p.fmt, p.cost, strict=True)]


def _forward(rows: list[tuple]) -> np.ndarray:
    """costs[i, j]: the cheapest way from reading i of the first row to reading j of the last, without the first's own cost."""
    n = len(rows[0][0])
    total = np.where(np.eye(n, dtype=bool), 0.0, np.inf)
    for a, b in zip(rows, rows[1:], strict=False):
        if len(a[0]) == 1 and len(b[0]) == 1:
            total = total + _step(a, b)
        else:
            total = (total[:, :, None] + _step(a, b)[None]).min(1)
    return total


def _summary(p: pd.DataFrame) -> pd.DataFrame:
    rows = _rows(p)
    first, last, total = rows[0], rows[-1], _forward(rows)
    x = {"source": p.source.iat[0], "block": p.block.iat[0], "total": total.ravel()}
    x |= {f"first_{k}": v for k, v in zip(("us", "fmt", "cost"), first, strict=True)} | {f"last_{k}": v for k, v in zip(("us", "fmt", "cost"), last, strict=True)}
    return pd.DataFrame([x])[["source", "block", "total", "first_us", "first_fmt", "first_cost", "last_us", "last_fmt", "last_cost"]]


def _chain(p: pd.DataFrame) -> pd.DataFrame:
    """Over one row per block of a source: the readings at both ends of each block."""
    p = p.sort_values("block")
    ends = [((np.asarray(r.first_us), np.asarray(r.first_fmt), np.asarray(r.first_cost)), (np.asarray(r.last_us), np.asarray(r.last_fmt), np.asarray(r.last_cost))) for r in p.itertuples()]
    mats = [np.asarray(t).reshape(len(a[0]), len(b[0])) for t, (a, b) in zip(p.total, ends, strict=True)]
    best, back = ends[0][0][2], []
    for i, m in enumerate(mats):
        through = best[:, None] + m
        inner = through.argmin(0)
        left = through.min(0)
        if i + 1 < len(mats):
            over = left[:, None] + _step(ends[i][1], ends[i + 1][0])
            back.append((inner, over.argmin(0)))
            best = over.min(0)
        else:
            back.append((inner, None))
    out, last = [], int(left.argmin())
    for i in range(len(mats) - 1, -1, -1):
        first = int(back[i][0][last])
        out.append((p.source.iat[i], p.block.iat[i], first, last))
        if i:
            last = int(back[i - 1][1][first])
    return pd.DataFrame(out, columns=["source", "block", "first", "last"])


def _fill(key, p: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The choice within a block whose two ends are fixed."""
    if not len(p) or not len(ends):
        return pd.DataFrame({"id": pd.Series([], dtype="int64"), "utc_us": pd.Series([], dtype="int64")})
    rows, ids = _rows(p), np.sort(p.id.unique())
    start, end = int(ends["first"].iat[0]), int(ends["last"].iat[0])
    cost, back = np.where(np.arange(len(rows[0][0])) == start, 0.0, np.inf), []
    for a, b in zip(rows, rows[1:], strict=False):
        over = cost[:, None] + _step(a, b)
        back.append(over.argmin(0))
        cost = over.min(0)
    chosen = [end]
    for x in reversed(back):
        chosen.append(int(x[chosen[-1]]))
    return pd.DataFrame({"id": ids, "utc_us": [r[0][k] for r, k in zip(rows, reversed(chosen), strict=True)]})


def choose(found: DataFrame) -> DataFrame:
    """(id, utc_us) by the Viterbi pass over the readings of `candidates`."""
    ends = found.groupBy("source", "block").applyInPandas(_summary, "source string, block long, total array<double>, first_us array<long>, first_fmt array<int>, first_cost array<double>, last_us array<long>, last_fmt array<int>, last_cost array<double>")
    fixed = ends.groupBy("source").applyInPandas(_chain, "source string, block long, first int, last int")
    return found.groupBy("source", "block").cogroup(fixed.groupBy("source", "block")).applyInPandas(_fill, "id long, utc_us long")


def instants(records: DataFrame, sources: DataFrame, convention: float = CONVENTION) -> DataFrame:
    """(id, utc_us): one UTC instant for each record that has a readable time. convention: as in `candidates`."""
    return choose(cut(candidates(records, sources, convention)))


#: The form in which instants are stored.
STORED_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\+00:00$"


def normalised(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, utc_ms) of the records whose value isn't in the stored form and that have an instant."""
    rewritten = records.where(F.col("published_at").isNull() | ~(F.col("published_at").rlike(STORED_FORM) & (F.length("published_at") == 25))).select("id").distinct()
    return instants(records, sources).join(rewritten, "id", "left_semi").select("id", F.floor(F.col("utc_us") / 1000).cast("long").alias("utc_ms"))
