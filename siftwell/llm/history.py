"""New batches checked against all accepted history: persisted inverted-file cells of full vectors.

A record's vector is its set of two-word sequences, kept whole, and in 512 bits of parity: the bits in which two vectors
differ never outnumber the sequences that only one of the records holds, so they bound the distance from below.

A cell holds the records of one slab of SLAB_DAYS days whose vectors' hash falls in one range, about CELL_ROWS of them; copies lie together. (By
their least sequence records that are alike would lie together as well, but popular sequences make cells of hundreds, which nothing skips.) Its bounds
are its days, its sizes and its support: a bit for every sequence that any of its records holds. What of a query's sequences isn't in the
support is in no record of the cell, which bounds the distance of the whole cell from below. A query probes the cells whose bounds leave
room for a match and skips all others; within a cell the vector bits decide, and what they leave room for is compared exactly. So
no match is missed.

The history is three tables in the shared folder. Cells: a row a cell with its bounds and the list of its records (id, time, size and bits), a folder
an append and era (ERA_SLABS slabs), in order of slabs, so that files and row groups of other days are skipped. Rows: the full vectors, in folders
as well, in order of slabs and cells. Pages: the pages of accepted records with their ids. A check reads the cells of the slabs near its
records, of the full vectors shuffles only those that the bits of a probed cell leave room for, and, as pages have no limit of time, reads
the table of pages, which is looked up without being shuffled. Accepted records are appended to all
three; nothing that is there is rewritten for it.

Acceptance in order of batch and id is settled in rounds: of the undecided records, those without an undecided
earlier relative are accepted, and their relatives rejected, until none is left. Copies (same page, fingerprint,
instant and sequences, of which some rule holds) are one class, of which only the first can be accepted.

Defined results: a null or blank address, fingerprint or an unreadable time takes no part in the rule that needs it; summaries of fewer than 12 words
take no part in likeness; equal order can't occur, as ids are unique; repeated rows count once; rows without a batch come first; whole texts are
treated; extra columns are ignored; empty batches give no rows, and an empty history only the batches' own repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.urls import page_key
from siftwell.llm.likeness import LIKE, gram_sets, words_of
from siftwell.llm.neardup import ODD, parities
from siftwell.operators.timeline import instants
from siftwell.session import cut, scratch_path

DAYS_APART = 3
SLAB_DAYS = 3
#: Slabs whose cells lie in one folder.
ERA_SLABS = 16
DAY_US = 86_400_000_000
SPAN = DAYS_APART * DAY_US
CELL_ROWS = 8
#: Bits of a cell's support, about eight a sequence.
SUPPORT = 1 << 13
#: Cells and queries that one task compares at a time.
CELLS_AT_ONCE, QUERIES_AT_ONCE = 1024, 1 << 16
#: Batches that are checked in one lot: each lot costs the driver some fifty shuffles to plan, whatever it holds.
TOGETHER = 4
#: Undecided rows and links of a lot that one task settles in order; more are settled in rounds, with the same result.
ONE_TASK = 1_000_000
#: Keys up to which a batch's side is broadcast (a few MB); more are joined by shuffle.
BROADCAST_ROWS = 100_000

_V = [f"v{i}" for i in range(ODD)]
_VECTORS = "id long, us long, batch_id int, page long, page2 int, fp string, one long, two long, n int, place int, " + "".join(f"{v} long, " for v in _V) + "grams array<int>"
_ROWS = "id long, us long, fp string, n int, " + "".join(f"{v} long, " for v in _V) + "grams array<int>, cell int, slab int, part string"
_CELLS = "slab int, cell int, n_min int, n_max int, us_min long, us_max long, support binary, ids array<long>, at array<long>, sizes array<int>, bits binary"
_BOUNDS = _CELLS + ", part string"
_PAGES = "page long, page2 int, id long"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        at, offsets, g = gram_sets([words_of(t, s) for t, s in zip(c["title"].to_pylist(), c["summary"].to_pylist(), strict=True)])
        n = b.num_rows
        size, place, one, two = np.zeros(n, "int32"), np.zeros(n, "int32"), np.zeros(n, "int64"), np.zeros(n, "int64")
        vec, full = np.zeros((ODD, n), "int64"), np.zeros(n, "int64")
        if len(at):
            size[at] = full[at] = np.diff(offsets)
            with np.errstate(over="ignore"):
                whole = np.add.reduceat(g, offsets[:-1])
                one[at], place[at] = whole.view("int64"), ((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype("int32")
                two[at] = np.bitwise_xor.reduceat(g * np.uint64(0xD6E8FEB86659FD93) ^ (g >> np.uint64(32)), offsets[:-1]).view("int64")
            vec[:, at] = parities(offsets, g).view("int64")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]), pa.int32()), pa.array((g >> np.uint64(32)).astype("uint32").view("int32"), pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*(c[k] for k in ("id", "us", "batch_id", "page", "page2", "fp")), *(pa.array(x) for x in (one, two, size, place, *vec)), lists], names=["id", "us", "batch_id", "page", "page2", "fp", "one", "two", "n", "place", *_V, "grams"]
        )


def _vectorised(records: DataFrame, times: DataFrame, unique: bool = False) -> DataFrame:
    """Rows of _VECTORS of records (id, title, summary, canonical_url, fingerprint and, if there, batch_id); times: (id, utc_us). unique: no id occurs twice."""
    page = page_key(F.col("canonical_url"))
    batch = F.coalesce("batch_id", F.lit(-1)) if "batch_id" in records.columns else F.lit(-1)
    rows = records.where("id is not null").select(
        "id", batch.cast("int").alias("batch_id"), "title", "summary", F.when(page.isNotNull(), F.xxhash64(page)).alias("page"), F.when(page.isNotNull(), F.hash(page)).alias("page2"), F.when(F.trim("fingerprint") != "", F.trim("fingerprint")).alias("fp")
    )
    rows = _merged(rows if unique else rows.dropDuplicates(["id"]), times.select("id", F.col("utc_us").alias("us")), "id", "left")  # texts are moved, not vectors
    return rows.mapInArrow(_vector_rows, _VECTORS)


def _slab(us: Column) -> Column:
    return F.floor(us / (SLAB_DAYS * DAY_US)).cast("int")


def _era(slab: Column) -> Column:
    return F.floor(slab / ERA_SLABS).cast("int")


def _slabs_near(us: Column) -> Column:
    return F.explode(F.sequence(_slab(us - SPAN), _slab(us + SPAN)))


def _placed(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Rows of _VECTORS with their slab and their cell; rows without sequences are in cell -1. times: (id, utc_us) of these rows, which tell
    how many cells a slab needs."""
    sizes = times.groupBy(_slab(F.col("utc_us")).alias("slab")).agg(F.ceil(F.count("*") / CELL_ROWS).alias("cells"))  # a row a slab
    cell = F.when(F.col("n") > 0, F.shiftright(F.col("place").cast("long") * F.col("cells"), 31).cast("int")).otherwise(-1)
    return rows.withColumn("slab", _slab(F.col("us"))).join(sizes, "slab", "left").withColumn("cell", cell).drop("cells", "place")


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_CELLS of rows (slab, cell, id, us, n, *_V, grams) in order of slab and cell; a cell that lies in two batches gets two rows."""
    for b in batches:
        for s in range(0, b.num_rows, 8192):
            part = b.slice(s, 8192)
            slab, cell, ids, us, n = (part.column(i).to_numpy() for i in range(5))
            bits = np.stack([part.column(5 + i).to_numpy() for i in range(ODD)], 1)
            begins = np.concatenate([[0], np.flatnonzero((slab[1:] != slab[:-1]) | (cell[1:] != cell[:-1])) + 1])
            ends = np.array([*begins, len(slab)], "int32")
            own = np.repeat(np.arange(len(begins)), np.diff(ends))
            grams, sizes = part.column(5 + ODD).flatten().to_numpy(), part.column(5 + ODD).value_lengths().to_numpy()
            held = np.zeros((len(begins), SUPPORT), bool)
            held[np.repeat(own, sizes), grams.view("uint32") & np.uint32(SUPPORT - 1)] = True
            support = np.packbits(held, axis=1, bitorder="little")
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids, us, n)]
            codes = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((ends * (8 * ODD)).astype("int32").tobytes()), pa.py_buffer(bits.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(slab[begins]), pa.array(cell[begins]), *(pa.array(f.reduceat(x, begins)) for x, f in ((n, np.minimum), (n, np.maximum), (us, np.minimum), (us, np.maximum))), pa.array([x.tobytes() for x in support], pa.binary()), *lists, codes],
                names=["slab", "cell", "n_min", "n_max", "us_min", "us_max", "support", "ids", "at", "sizes", "bits"],
            )


def _bounds(rows: DataFrame) -> DataFrame:
    """_CELLS: the bounds of the cells of rows, and the list of their records with times, sizes and bits."""
    return rows.where("cell >= 0").select("slab", "cell", "id", "us", "n", *_V, "grams").mapInArrow(_cell_rows, _CELLS)


def _held_by(cells: pa.Table) -> np.ndarray:
    """[SUPPORT + 1, words]: for each bit of a support the cells that have it set, 64 to a word; the last row is empty."""
    bits = np.frombuffer(b"".join(cells.column("support").to_pylist()), "uint8").reshape(cells.num_rows, SUPPORT // 8)
    across = np.packbits(np.unpackbits(bits, axis=1, bitorder="little").T, axis=1, bitorder="little")
    out = np.zeros((SUPPORT + 1, -(-cells.num_rows // 64) * 8), "uint8")
    out[:SUPPORT, : across.shape[1]] = across
    return out.view("uint64")


def _overlaps(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[digits, queries, words]: how many of each query's sequences are in each cell's support, as planes of the counts' binary digits.

    at: [queries, most], the bits of each query's sequences, SUPPORT where it has no more. A sequence is added for 64 cells at a time, by carrying.
    """
    planes = np.zeros((int(at.shape[1]).bit_length(), len(at), held.shape[1]), "uint64")
    for k in range(at.shape[1]):
        carry = held[at[:, k]]
        for digit in planes[: (k + 1).bit_length()]:
            digit ^= carry
            carry &= ~digit  # where a digit was one, it is nought now and carries on
    return planes


def _reached(planes: np.ndarray, least: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, cell, count) where the count is at least that of the query; digits are compared from the lowest up, for 64 cells at a time."""
    more = np.full(planes.shape[1:], ~np.uint64(0))
    for k, digit in enumerate(planes):
        wanted = np.where((least >> k) & 1, ~np.uint64(0), np.uint64(0))[:, None]
        more = (digit & ~wanted) | (more & ~(digit ^ wanted))
    more[least >= 1 << len(planes)] = 0
    q, c = np.nonzero(np.unpackbits(more.view("uint8"), axis=1, count=cells, bitorder="little"))
    word, shift = c >> 6, (c & 63).astype("uint64")
    return q, c, sum((((d[q, word] >> shift) & np.uint64(1)).astype("int64") << k for k, d in enumerate(planes)), np.zeros(len(q), "int64"))


def _suits(us: np.ndarray, n: np.ndarray, cells: pa.Table, c: np.ndarray | slice) -> np.ndarray:
    """Whether the days and sizes of cells suit queries."""
    low, high, first, last = (cells.column(x).to_numpy()[c] for x in ("n_min", "n_max", "us_min", "us_max"))
    return (first <= us + SPAN) & (last >= us - SPAN) & (high >= n * LIKE) & (low * LIKE <= n)


def _rooms(asked: pa.Table, cells: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, cell): the cells whose days and sizes suit each query and whose support leaves room for a match."""
    held, low = _held_by(cells), cells.column("n_min").to_numpy()
    us, n = asked.column("us").to_numpy(), asked.column("n").to_numpy().astype("int64")
    grams = asked.column("grams").combine_chunks()
    bits, ends = (grams.flatten().to_numpy().view("uint32") & np.uint32(SUPPORT - 1)).astype("int32"), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
    order, s = np.argsort(n, kind="stable")[::-1], 0
    while s < len(order):
        most = int(n[order[s]])
        some = order[s : s + max(1, min(512, (1 << 22) // max(most, cells.num_rows)))]
        s += len(some)
        at = np.full((len(some), most), SUPPORT, "int32")
        for k, i in enumerate(some):
            at[k, : ends[i + 1] - ends[i]] = bits[ends[i] : ends[i + 1]]
        share = LIKE / (1 + LIKE)  # of both sizes, that two records have in common at least; the other has at least LIKE of the query's size
        q, c, both = _reached(_overlaps(held, at), np.ceil(n[some] * (1 + LIKE) * share - 1e-9).astype("int64"), cells.num_rows)
        q = some[q]
        room = (both >= (n[q] + low[c]) * share - 1e-9) & _suits(us[q], n[q], cells, c)
        yield q[room], c[room]


def _candidates(asked: pa.Table, cells: pa.Table) -> pa.Table:
    """(old, new, part): the records of the cells with room whose own bits leave room as well. asked: new, us, n, *_V, grams; both of one slab."""
    out = [[np.empty(0, "int64")] * 3]
    if asked.num_rows and cells.num_rows:
        ids, at, sizes = (cells.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "at", "sizes"))
        bits = np.frombuffer(b"".join(cells.column("bits").to_pylist()), "uint64").reshape(-1, ODD)
        begins = np.concatenate([[0], np.cumsum(cells.column("ids").combine_chunks().value_lengths().to_numpy())]).astype("int64")
        new, us, n = (asked.column(c).to_numpy() for c in ("new", "us", "n"))
        own = np.stack([asked.column(v).to_numpy() for v in _V], 1).view("uint64")
        for q, c in _rooms(asked, cells):
            count = np.diff(begins)[c]
            cuts = np.searchsorted(np.cumsum(count), np.arange(1 << 18, count.sum() + (1 << 18), 1 << 18))
            for s, e in zip([0, *cuts], [*cuts, len(c)], strict=True):
                k = count[s:e]
                i = np.repeat(q[s:e], k)
                cell = np.repeat(c[s:e], k)
                j = begins[cell] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
                near = (np.abs(us[i] - at[j]) <= SPAN) & (new[i] != ids[j])
                i, j, cell = i[near], j[near], cell[near]
                room_left = np.bitwise_count(own[i] ^ bits[j]).sum(1, dtype="int64") <= (n[i].astype("int64") + sizes[j]) * ((1 - LIKE) / (1 + LIKE))
                out.append([ids[j[room_left]], new[i[room_left]], cell[room_left]])
    old, new, cell = (np.concatenate(x) for x in zip(*out, strict=True))
    parts = cells.column("part").take(pa.array(cell)) if len(cell) else pa.array([], pa.string())
    return pa.table([pa.array(old), pa.array(new), parts], names=["old", "new", "part"])


def _skipped(asked: pa.Table, cells: pa.Table) -> pa.Table:
    """(part, suit, probed): by part, how many cells suit queries in days and sizes, and how many of them are probed."""
    suit, probed = np.zeros(cells.num_rows, "int64"), np.zeros(cells.num_rows, "int64")
    if asked.num_rows and cells.num_rows:
        for us, n in zip(asked.column("us").to_pylist(), asked.column("n").to_pylist(), strict=True):
            suit += _suits(us, n, cells, slice(None))
        for _, c in _rooms(asked, cells):
            probed += np.bincount(c, minlength=cells.num_rows)
    return pa.table([cells.column("part"), pa.array(suit), pa.array(probed)], names=["part", "suit", "probed"]).group_by("part").aggregate([("suit", "sum"), ("probed", "sum")]).select(["part", "suit_sum", "probed_sum"]).rename_columns(["part", "suit", "probed"])


def _merged(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting: a lot's many small joins would otherwise each be collected and kept by the driver as a broadcast."""
    return a.join(b.hint("merge"), on, how)


class History:
    """All that was accepted, as tables of cells, bounds and pages in the shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, items: DataFrame, times: DataFrame, path: str | None = None) -> History:
        """Everything in `items` is accepted; times: (id, utc_us)."""
        made = cls(items.sparkSession, path or scratch_path(items.sparkSession, "history"))
        unique = items.groupBy("id").count().where("count > 1").isEmpty()  # ids alone are compared, which spares sorting all texts
        made.append(_placed(_vectorised(items, times, unique), times), "base")
        return made

    def append(self, placed: DataFrame, name: str) -> None:
        """Adds accepted rows, as of `_placed`, to their cells; a name written again replaces what it held."""
        rows = placed.select(*(c for c in _COLUMNS if c != "part"), "page", "page2", _era(F.col("slab")).alias("era"))  # rows without a time have pages only
        rows.hint("rebalance", "era").sortWithinPartitions("era", "slab", "cell").write.mode("overwrite").partitionBy("era").parquet(f"{self.path}/rows/part={name}")
        kept = self._read("rows", _ROWS + ", page long, page2 int, era int", [f"part={name}"])
        bounds = _bounds(kept.where("slab is not null")).withColumn("era", _era(F.col("slab")))
        bounds.hint("rebalance", "era").sortWithinPartitions("era", "slab").write.mode("overwrite").partitionBy("era").parquet(f"{self.path}/bounds/part={name}")
        kept.where("page is not null").select("page", "page2", "id").hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/pages/part={name}")

    def _below(self, folder: str) -> list[str]:
        """The names of what lies in a folder, by one listing."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, table: str, schema: str, folders: list[str]) -> DataFrame:
        """Rows of the folders of a table; other folders aren't even listed."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/{f}" for f in folders))

    def _near(self, table: str, schema: str, slabs: list[int]) -> DataFrame:
        eras = {f"era={s // ERA_SLABS}" for s in slabs}
        folders = [f"{part}/{era}" for part in self._below(table) if part.startswith("part=") for era in self._below(f"{table}/{part}") if era in eras]
        return self._read(table, schema + ", era int", folders).where(F.col("slab").isin(slabs))

    def rows(self, slabs: list[int]) -> DataFrame:
        """_ROWS of the slabs; no folder of another era is read."""
        return self._near("rows", _ROWS, slabs).select(*_COLUMNS)

    def bounds(self, slabs: list[int]) -> DataFrame:
        """_BOUNDS of the slabs' cells, from what each append wrote."""
        return self._near("bounds", _BOUNDS, slabs).drop("era")

    def pages(self) -> DataFrame:
        return self._read("pages", _PAGES, [p for p in self._below("pages") if p.startswith("part=")])

    def drop(self) -> None:
        """Deletes the tables; what checks returned stays, as it is at rest elsewhere."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def check(self, batch: DataFrame, times: DataFrame, append_as: str | None = None) -> DataFrame:
        """(accepted_id, id) for the rows of one or more batches that repeat accepted records; the accepted are appended.

        batch: id, batch_id, title, summary, canonical_url, fingerprint; times: (id, utc_us) of its rows.
        """
        order = F.struct("batch_id", "id")
        times = _merged(times, batch.select("id"), "id", "left_semi")
        # copies repeat each other by some rule; rows that none applies to stand alone
        by_rule = F.col("page").isNotNull() | (F.col("us").isNotNull() & (F.col("fp").isNotNull() | (F.col("n") > 0)))
        new = cut(_placed(_vectorised(batch, times), times).withColumn("solo", F.when(~by_rule, F.col("id"))))
        kinds = ["page", "page2", "fp", "us", "one", "two", "solo"]
        reps = new.groupBy(*kinds).agg(F.min(order).alias("first"))
        same = [F.col(f"new.{k}").eqNullSafe(F.col(f"reps.{k}")) for k in kinds]
        members = cut(new.alias("new").join(reps.alias("reps").hint("merge"), same).select("new.id", "new.batch_id", F.col("new.page").alias("page"), F.col("new.page2").alias("page2"), F.col("first.id").alias("rep")))
        heads = cut(_merged(new, members.where("id = rep").select("id"), "id", "left_semi").withColumn("part", F.lit("")).repartition("slab").sortWithinPartitions("slab", "cell"))
        related = cut(self._related(heads))
        old, own = related.where("part != ''").select("old", "new"), related.where("part = '' and old < new").select("old", "new")
        asked = members.where("page is not null").select("page", "page2").distinct()
        held = cut(self.pages().join(F.broadcast(asked) if members.count() <= BROADCAST_ROWS else asked, ["page", "page2"]).select("page", "page2", F.col("id").alias("accepted_id")))
        accepted = cut(self._settle(heads, old, own, held))
        found = cut(self._repeats(members, old, own, held, accepted))
        if append_as:
            self.append(_merged(heads, accepted.select("id"), "id", "left_semi"), append_as)
        return found

    def _related(self, heads: DataFrame) -> DataFrame:
        """(old, new, part) of records that are near in time and have one fingerprint or are alike; part is '' where both are of the batch."""
        timed = heads.where("us is not null")
        slabs = [r["slab"] for r in timed.select(_slabs_near(F.col("us")).alias("slab")).distinct().collect()]  # one a slab of days
        rows = self.rows(slabs).unionByName(timed.select(*_COLUMNS))
        asked = timed.where("fp is not null").select(F.col("id").alias("new"), F.col("us").alias("us_new"), "fp", _slabs_near(F.col("us")).alias("slab"))
        by_print = rows.where("fp is not null").select(F.col("id").alias("old"), F.col("us").alias("us_old"), "fp", "slab", "part").join(asked.hint("merge"), ["fp", "slab"])
        by_print = by_print.where((F.abs(F.col("us_old") - F.col("us_new")) <= SPAN) & (F.col("old") != F.col("new"))).select("old", "new", "part")
        near = cut(self._probe(heads, slabs, _candidates, "old long, new long, part string").distinct())
        ids = near.select(F.col("old").alias("id"), "part").distinct()
        held = rows.where("cell >= 0").join(F.broadcast(ids) if near.count() <= BROADCAST_ROWS else ids, ["id", "part"], "left_semi").select(F.col("id").alias("old"), "part", F.col("grams").alias("g_old"))
        both = F.size(F.array_intersect("g_old", "g_new"))
        pairs = _merged(_merged(near, held, ["old", "part"]), timed.select(F.col("id").alias("new"), F.col("grams").alias("g_new")), "new")
        alike = pairs.where(both >= LIKE * (F.size("g_old") + F.size("g_new") - both)).select("old", "new", "part")
        return by_print.unionByName(alike).distinct()

    def probes(self, heads: DataFrame, slabs: list[int]) -> DataFrame:
        """(part, suit, probed): how many pairs of a head and a cell suit each other in days and sizes, and how many of them are probed; the others are skipped."""
        return self._probe(heads, slabs, _skipped, "part string, suit long, probed long").groupBy("part").agg(F.sum("suit").alias("suit"), F.sum("probed").alias("probed"))

    def _probe(self, heads: DataFrame, slabs: list[int], function, schema: str) -> DataFrame:
        """What a function of queries and cells of one slab says of the heads and the cells near them; the heads' own cells are of the part ''."""
        asked = heads.where("us is not null and cell >= 0").select(F.col("id").alias("new"), "us", "n", *_V, "grams")
        held, own = self.bounds(slabs), heads.where("us is not null and cell >= 0")
        cells = held.unionByName(_bounds(own).withColumn("part", F.lit("")))
        sizes = held.select("slab", "cell").unionByName(own.select("slab", "cell").distinct()).groupBy("slab").agg(F.ceil(F.count("*") / CELLS_AT_ONCE).cast("int").alias("chunks")).collect()  # one a slab of days
        if not sizes:
            return self.spark.createDataFrame([], schema)
        chunks = F.broadcast(self.spark.createDataFrame([tuple(r) for r in sizes], "slab int, chunks int"))
        blocks = 1 + asked.count() // QUERIES_AT_ONCE
        to = [F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")]
        cells = cells.join(chunks, "slab").select(*(c for c in cells.columns), F.pmod(F.xxhash64("part", "cell"), F.col("chunks")).cast("int").alias("chunk"), *to)
        asked = asked.select("*", _slabs_near(F.col("us")).alias("slab"), F.pmod(F.xxhash64("new"), F.lit(blocks)).cast("int").alias("block")).join(chunks, "slab")
        asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        keys = ["slab", "chunk", "block"]
        return asked.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(function, schema)

    def _settle(self, heads: DataFrame, old: DataFrame, own: DataFrame, held: DataFrame) -> DataFrame:
        """(id, batch_id, page, page2) of the accepted heads."""
        open_ = _merged(heads.select("id", "batch_id", "page", "page2"), old.select(F.col("new").alias("id")).distinct(), "id", "left_anti")
        open_ = cut(_merged(open_, held.select("page", "page2").distinct(), ["page", "page2"], "left_anti"))
        if open_.count() + own.count() <= ONE_TASK:
            nodes = open_.select(F.lit(0).alias("k"), "id", "batch_id", "page", "page2")
            return nodes.groupBy("k").cogroup(own.select(F.lit(0).alias("k"), "old", "new").groupBy("k")).applyInArrow(_settled, "id long, batch_id int, page long, page2 int")
        done = None
        while not open_.isEmpty():
            live = own.join(open_.select(F.col("id").alias("old"), F.col("batch_id").alias("b_old")), "old").join(open_.select(F.col("id").alias("new"), F.col("batch_id").alias("b_new")), "new")
            later = F.struct("b_old", "old") < F.struct("b_new", "new")
            waits = live.select(F.when(later, F.col("new")).otherwise(F.col("old")).alias("id")).distinct()
            first = open_.where("page is not null").groupBy("page", "page2").agg(F.min(F.struct("batch_id", "id")).alias("x")).select(F.col("x.id").alias("id"))
            ready = open_.join(waits, "id", "left_anti")
            ready = cut(ready.where("page is null").unionByName(ready.join(first, "id", "left_semi").where("page is not null")))
            hit = live.join(ready.select(F.col("id").alias("old")), "old", "left_semi").select(F.col("new").alias("id"))
            hit = hit.union(live.join(ready.select(F.col("id").alias("new")), "new", "left_semi").select(F.col("old").alias("id"))).union(ready.select("id"))
            taken = ready.where("page is not null").select("page", "page2").distinct()
            open_ = cut(open_.join(hit.distinct(), "id", "left_anti").join(taken, ["page", "page2"], "left_anti"))
            done = ready if done is None else done.unionByName(ready)
        return open_ if done is None else done

    def _repeats(self, members: DataFrame, old: DataFrame, own: DataFrame, held: DataFrame, accepted: DataFrame) -> DataFrame:
        none = F.lit(None).cast("int").alias("b")  # the batch of what was accepted before
        pages = held.select("accepted_id", none, "page", "page2").unionByName(accepted.where("page is not null").select(F.col("id").alias("accepted_id"), F.col("batch_id").alias("b"), "page", "page2"))
        by_page = _merged(members.where("page is not null"), pages, ["page", "page2"]).where("accepted_id != id").select("accepted_id", "id", "b", "batch_id")
        both = own.select("old", "new").union(own.select("new", "old")).union(accepted.select("id", F.col("id").alias("new"))).toDF("accepted_id", "rep")
        won = _merged(both, accepted.select(F.col("id").alias("accepted_id"), F.col("batch_id").alias("b")), "accepted_id")
        related = old.select(F.col("old").alias("accepted_id"), F.col("new").alias("rep"), none).unionByName(won)
        by_rep = _merged(members, related, "rep").select("accepted_id", "id", "b", "batch_id")
        earlier = F.col("b").isNull() | (F.struct("b", "accepted_id") < F.struct("batch_id", "id"))
        return by_page.unionByName(by_rep).where(earlier).select("accepted_id", "id").distinct()


def _settled(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """The rounds of `_settle` for few rows, in order: a row is accepted unless an accepted one is its relative or has its page."""
    beside: dict[int, list[int]] = {}
    for a, b in zip(edges.column("old").to_pylist(), edges.column("new").to_pylist(), strict=True):
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    ids, batch, page, page2 = (nodes.column(c).to_pylist() for c in ("id", "batch_id", "page", "page2"))
    accepted, pages, kept = set(), set(), []
    for k in sorted(range(len(ids)), key=lambda k: (batch[k], ids[k])):
        own_page = (page[k], page2[k])
        if (page[k] is None or own_page not in pages) and accepted.isdisjoint(beside.get(ids[k], ())):
            accepted.add(ids[k])
            pages.add(own_page)
            kept.append(k)
    return nodes.select(["id", "batch_id", "page", "page2"]).take(pa.array(kept, pa.int64()))


def repeats(items: DataFrame, incoming: DataFrame, sources: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(accepted_id, id): the batches of `incoming`, in order, against `items` and what was accepted before.

    Batches that have arrived are checked and appended in lots of `together`; any number gives the same rows. The history is made for this call and
    deleted at its end; one that is kept is built, asked and appended to by `History`.
    """
    kept = History.build(items, instants(items, sources))
    times = cut(instants(incoming.select("id", "source_id", "published_at"), sources))
    found = None
    arrived = [r["batch_id"] for r in incoming.select("batch_id").distinct().orderBy(F.asc_nulls_first("batch_id")).collect()]  # one a batch
    for k in range(0, len(arrived), together):
        lot = arrived[k : k + together]
        batch = incoming.where(F.col("batch_id").isin([b for b in lot if b is not None]) | (F.col("batch_id").isNull() & F.lit(None in lot)))
        now = kept.check(batch, times, f"batches-{k}")
        found = now if found is None else found.unionByName(now)
    kept.drop()
    return found if found is not None else kept.spark.createDataFrame([], "accepted_id long, id long")
