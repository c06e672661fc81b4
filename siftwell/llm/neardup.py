"""Near-duplicate records: a binary-trie self-join of bit sketches.

Each record that takes part is sketched by 256 bits, two of each of 128 minhashes: two records differ in a bit with half
the share by which their likeness falls short of one. The sketches of a block are a binary trie; the self-join goes down pairs of its
nodes together, adds up the bits in which the two paths differ, and drops a pair of nodes once the Hamming budget
is spent. Of what is left, pairs with fewer than 65 equal pieces (two bits of a minhash) are dropped, and the rest is compared exactly. Equal pieces tell
more than bits: unrelated pairs of a block pass both a fifth as often as a budget of 86 bits alone, and a pair of likeness 0.5 fails either
with probability 0.0028 (that budget alone: 0.0032), one of 0.55 with 0.0001, one of 0.6 below 0.00001. Unrelated pairs of a block differ in some 107 bits
and part from each other within the first twenty or so, where the budget isn't spent: there the walk can drop nothing, and whole nodes are compared at once.

Blocks: records that agree in one of 40 bands of three minhashes, so that the nodes of one trie can meet in one task. A
pair of likeness 0.5 meets with probability 0.995, one of 0.55 with 0.9993, one of 0.6 with 0.9999. Records of one and the
same set of sequences are one class: only its representative is joined, and its members are put back at the end.
A block of more than BLOCK_ROWS rows is split into parts, each pair of parts being its own task; such blocks are found
by bucket counts first, and no row is left out. Texts of common phrases meet in blocks that grow with the collection, so compared pairs grow with its
square, at some 10 ns each. Where no miss may be risked,
`exact_links` finds the same links over the rarest sequences.

Defined results: records whose summary is null or of fewer than 12 words take no part; repeated rows of one id are one record;
a pair is given once, smaller id first; a group holds all that pairs connect, is named by its smallest id, and records without a pair are in none; ties can't occur; whole texts are treated; extra columns are ignored; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.likeness import LIKE, gram_arrays, gram_sets, with_likeness, words_of
from siftwell.operators.cluster import components
from siftwell.session import cut

BANDS, ROWS, HASHES, BITS = 40, 3, 128, 256
WORDS = BITS // 64
BUDGET, PIECES = 90, 65
BLOCK_ROWS = 20_000
BUCKETS = 1 << 16
ROUNDS = 4
ODD = 8
_BITS, _ODDS = [f"w{i}" for i in range(WORDS)], [f"o{i}" for i in range(ODD)]
_MOST_PAIRS = 1 << 21
_TILE, _TILED, _GATHERED = 256, 600, 1 << 17

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**63, HASHES, dtype="uint64") * np.uint64(2) + np.uint64(1)
_CHUNK = 512


def sketches(offsets: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit band codes [n, BANDS] and sketches [WORDS, n] of each set."""
    n = len(offsets) - 1
    bands, mix = np.zeros((BANDS, n), "uint64"), np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros((WORDS, n), "uint64")
    with np.errstate(over="ignore"):
        for s in range(0, n, _CHUNK):  # what fits the processor's cache
            e = min(n, s + _CHUNK)
            own, begins = grams[offsets[s] : offsets[e]], offsets[s:e] - offsets[s]
            for j in range(HASHES):
                least = np.minimum.reduceat(own * _MUL[j], begins)
                bits[j // 32, s:e] |= ((least >> np.uint64(37)) & np.uint64(3)) << np.uint64(62 - 2 * (j % 32))
                if j < BANDS * ROWS:
                    bands[j // ROWS, s:e] = (bands[j // ROWS, s:e] ^ least) * mix
    return (bands >> np.uint64(32)).astype("uint32").T.copy(), bits


def parities(offsets: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """[ODD, n] words of the parity of each set's sequences, dealt to 64 * ODD bits by their hash."""
    bit = (grams >> np.uint64(20)) & np.uint64(64 * ODD - 1)
    one = np.uint64(1) << (bit & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), offsets[:-1]) for w in range(ODD)])


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, titles, summaries = (b.column(i).to_pylist() for i in range(3))
        rows, offsets, g = gram_sets([words_of(t, s) for t, s in zip(titles, summaries, strict=True)])
        if not len(rows):
            continue
        bands, bits = sketches(offsets, g)
        with np.errstate(over="ignore"):
            one = np.add.reduceat(g, offsets[:-1])
            two = np.bitwise_xor.reduceat(g * np.uint64(0xD6E8FEB86659FD93) ^ (g >> np.uint64(32)), offsets[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in rows], pa.int64())] + [pa.array(x.view("int64")) for x in (one, two, *bits, *parities(offsets, g))] + [pa.array(np.diff(offsets).astype("int32"))]
            + [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view("int32")))],
            names=["id", "one", "two", *_BITS, *_ODDS, "n", "bands"],
        )


def _partings(starts: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """For each row, how deep its path and that of the next row in its block part: 1 to BITS, or 0 where they don't or there is none."""
    out = np.zeros(len(bits[0]), "int64")
    for k in range(WORDS - 1, -1, -1):
        x = bits[k][:-1] ^ bits[k][1:]
        for by in (1, 2, 4, 8, 16, 32):
            x |= x >> np.uint64(by)
        np.copyto(out[:-1], 64 * k + 65 - np.bitwise_count(x).astype("int64"), where=x != 0)
    out[starts[1:] - 1] = 0
    return out


def trie_pairs(starts: np.ndarray, bits: list[np.ndarray], side: np.ndarray | None = None, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one block whose sketches differ in at most `budget` bits.

    Rows are sorted by block and sketch, so that a trie node is a range of rows; starts: where the blocks begin, and the end.
    side: if given, only pairs of rows with different sides count.
    A pair of nodes is followed while its rows part, on average, deeper than the budget left reaches. Where they part sooner the walk could drop hardly
    anything, as a level spends one bit at most, and it costs far more than the rest of all paths compared at once; so do pairs of small nodes.
    """
    lo, hi = starts[:-1], starts[1:]
    more = hi - lo > 1
    stack = [(0, lo[more], hi[more], lo[more], hi[more], np.zeros(int(more.sum()), "int64"))]
    deep = np.concatenate([[0], np.cumsum(_partings(starts, bits))]) if more.any() else None
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if not len(a0):
            continue
        mean = np.maximum(*((deep[end - 1] - deep[begin]) / np.maximum(1, end - 1 - begin) for begin, end in ((a0, a1), (b0, b1))))
        leaf = ((a1 - a0) * (b1 - b0) < _TILED) | (diff + mean - depth <= budget) | (depth == BITS)
        if leaf.any():
            yield from _leaves(a0[leaf], a1[leaf], b0[leaf], b1[leaf], bits, side, budget)
            a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        word, shift = bits[depth // 64], np.uint64(63 - depth % 64)
        ones = np.concatenate([[0], np.cumsum(((word >> shift) & np.uint64(1)).astype("int64"))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0  # node ranges of one depth are equal or apart
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am[~own], a1[~own], b0[~own], bm[~own], diff[~own] + 1)]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        alive = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, diff = (x[alive] for x in (a0, a1, b0, b1, diff))
        for k in range(0, len(a0), _MOST_PAIRS):
            stack.append((depth + 1, *(x[k : k + _MOST_PAIRS] for x in (a0, a1, b0, b1, diff))))


def _leaves(a0, a1, b0, b1, bits, side, budget):
    """Row pairs of pairs of nodes: large ones by tiles, small ones together in pieces of bounded size."""
    count = (a1 - a0) * (b1 - b0)
    large = count >= _TILED
    for p, q, r, s in zip(*(x[large].tolist() for x in (a0, a1, b0, b1)), strict=True):
        a, b = np.arange(p, q), np.arange(r, s)
        if side is None:
            yield from _tiles(a, b, p == r, bits, budget)
        else:
            yield from _tiles(a[side[a] == 0], b[side[b] == 1], False, bits, budget)
            if p != r:
                yield from _tiles(a[side[a] == 1], b[side[b] == 0], False, bits, budget)
    a0, a1, b0, b1, count = (x[~large] for x in (a0, a1, b0, b1, count))
    if not len(count):
        return
    cuts = np.searchsorted(np.cumsum(count), np.arange(_MOST_PAIRS, count.sum() + _MOST_PAIRS, _MOST_PAIRS), "left") + 1
    for s, e in zip([0, *cuts[:-1]], cuts, strict=True):
        n = count[s:e]
        if not n.sum():
            continue
        which = np.repeat(np.arange(s, min(e, len(count))), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (b1 - b0)[which]
        i, j = a0[which] + k // width, b0[which] + k % width
        keep = (a0[which] != b0[which]) | (i < j)
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        near = sum(np.bitwise_count(w[i] ^ w[j]).astype("int16") for w in bits) <= budget
        yield i[near], j[near]


def _tiles(a: np.ndarray, b: np.ndarray, own: bool, bits: list[np.ndarray], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a and b, or of a with itself, in tiles that fit the processor's cache."""
    x, y = [w[a] for w in bits], [w[b] for w in bits]
    for s in range(0, len(a), _TILE):
        for t in range(s if own else 0, len(b), _TILE):
            far = np.zeros((len(a[s : s + _TILE]), len(b[t : t + _TILE])), "uint16")
            for v, w in zip(x, y, strict=True):
                far += np.bitwise_count(v[s : s + _TILE, None] ^ w[None, t : t + _TILE])
            i, j = np.divmod(np.flatnonzero(far <= budget), far.shape[1])
            i, j = a[i + s], b[j + t]
            if own and s == t:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, side, id, *_BITS) sorted by key and part: the near pairs of each block."""
    held: list[np.ndarray] | None = None
    flush = 200_000

    def joined(cols: list[np.ndarray]):
        key, part, side, ids = cols[:4]
        bits = [x.view("uint64") for x in cols[4:]]
        begins = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]])
        block = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        many = np.diff(begins)[block] > 1
        side, ids, block, *bits = (x[many] for x in (side, ids, block, *bits))
        order = np.lexsort((*reversed(bits), block))
        side, ids, block, *bits = (x[order] for x in (side, ids, block, *bits))
        starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, "int64")
        # a part beside itself has side -1 and joins all its rows; two different parts have sides 0 and 1
        for crossed in (False, True):
            if crossed and not (side >= 0).any():
                break
            chosen = (side >= 0)[starts[:-1]] == crossed if len(starts) > 1 else np.empty(0, bool)
            for s, e in _runs(starts, chosen):
                for i, j in _gathered(trie_pairs(starts[s : e + 1], bits, side if crossed else None)):
                    near = equal_pieces(bits, i, j) >= PIECES
                    x, y = ids[i[near]], ids[j[near]]
                    x, y = np.minimum(x, y), np.maximum(x, y)
                    order = np.lexsort((y, x))
                    x, y = x[order], y[order]
                    keep = x != y
                    keep[1:] &= (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["id_a", "id_b"])

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4 + WORDS)]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]) >= flush:
            key, part = held[0], held[1]
            change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            if len(change):
                yield from joined([x[: change[-1]] for x in held])
                held = [x[change[-1] :].copy() for x in held]
    if held is not None and len(held[0]):
        yield from joined(held)


def equal_pieces(bits: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the HASHES two-bit pieces of both sketches, how many are equal."""
    apart = (w[i] ^ w[j] for w in bits)
    return HASHES - sum(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).astype("int16") for x in apart)


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in pieces of _GATHERED or more, except the last."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= _GATHERED:
            yield tuple(np.concatenate(k) for k in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(k) for k in zip(*held, strict=True))


def _runs(starts: np.ndarray, chosen: np.ndarray) -> list[tuple[int, int]]:
    """Runs of chosen blocks as (first, after last)."""
    out, s = [], None
    for k, c in enumerate([*chosen.tolist(), False]):
        if c and s is None:
            s = k
        elif not c and s is not None:
            out.append((s, k))
            s = None
    return out


def _keyed(rows: DataFrame, *columns: str, first: int = 0, n: int = BANDS) -> DataFrame:
    """(key, *columns): each row once for each of n bands from the first."""
    bands = rows.select(*columns, F.posexplode(F.slice("bands", first + 1, n)).alias("band", "code"))
    return bands.select((F.shiftleft(F.col("band").cast("long") + F.lit(first), 32) + (F.col("code").cast("long") + F.lit(1 << 31))).alias("key"), *columns)


def _hot(reps: DataFrame) -> DataFrame | None:
    """(key, parts) of the blocks of more than BLOCK_ROWS rows, or None. At most one row for BLOCK_ROWS of the keyed rows, so it may be broadcast."""
    keys = _keyed(reps)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    # keys are only counted where their bucket holds enough rows for one to be full; a bucket is a row of a table of at most BUCKETS
    full = cut(keys.groupBy(bucket).count().where(F.col("count") > BLOCK_ROWS).select("bucket"))
    if full.isEmpty():
        return None
    counts = keys.select("key", bucket).join(F.broadcast(full), "bucket", "left_semi").groupBy("key").count().where(F.col("count") > BLOCK_ROWS)
    hot = cut(counts.select("key", F.ceil(F.col("count") / (BLOCK_ROWS // 2)).cast("int").alias("parts")), freed=True)
    return None if hot.isEmpty() else hot


def _blocks(reps: DataFrame, hot: DataFrame | None, first: int = 0, n: int = BANDS) -> DataFrame:
    """(key, part, side, id, *_BITS) of n bands from the first, with hot blocks split into pairs of parts."""
    rows = _keyed(reps, "id", *_BITS, first=first, n=n)
    if hot is None:
        return rows.select("key", F.lit(0).alias("part"), F.lit(-1).alias("side"), "id", *_BITS)
    split = rows.join(F.broadcast(hot), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return split.select("key", (low * F.col("parts") + high).alias("part"), side.alias("side"), "id", *_BITS)


def classes(records: DataFrame) -> DataFrame:
    """(id, one, two, *_BITS, *_ODDS, n, bands) of each record that takes part, kept in the shared folder."""
    return cut(records.where("id is not null").select("id", "title", "summary").mapInArrow(_sketch_rows, "id long, one long, two long, " + "".join(f"{w} long, " for w in (*_BITS, *_ODDS)) + "n int, bands array<int>"))


def _may_be_alike(pairs: DataFrame, found: DataFrame, like: float) -> DataFrame:
    """The pairs whose parities leave room for the likeness; none that is alike is lost."""
    a, b = (found.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), *(F.col(o).alias(f"{o}_{x}") for o in _ODDS)).dropDuplicates([f"id_{x}"]) for x in "ab")
    differ = sum((F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in _ODDS), F.lit(0))
    room = (F.col("n_a") + F.col("n_b")) * ((1 - like) / (1 + like))
    return pairs.join(a, "id_a").join(b, "id_b").where(differ <= room).select("id_a", "id_b")


def exact_links(records: DataFrame, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """As `links`, with no chance of a miss: classes meet over the rarest of their sequences, of which pairs that are alike must share one.

    Of n sequences the n - ceil(like * n) + 1 rarest are enough. A sequence that many hold gives many meetings, so this costs more the more the corpus
    repeats itself; `links` costs in proportion to the records.
    """
    found = classes(records)
    reps = found.groupBy("one", "two").agg(F.min("id").alias("rep"))
    members = found.select("id", "one", "two").distinct().join(reps, ["one", "two"]).select("id", "rep")
    grams = cut(gram_arrays(records.where("id is not null").select("id", "title", "summary").dropDuplicates(["id"]).join(reps.select(F.col("rep").alias("id")), "id", "left_semi")))
    held = grams.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    held = held.join(held.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "g")  # what one class alone holds is rarest, and meets nothing
    ranked = held.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))  # the sequences of one text
    alone = F.col("n") - F.size("s")
    first = F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * like).cast("int") + 1 - alone))
    meets = ranked.select("id", "n", F.explode(first).alias("x")).select("id", "n", F.col("x.g").alias("g"))
    a, b = (meets.select(F.col("id").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), "g") for x in "ab")
    near = a.join(b, "g").where("rep_a < rep_b").where((F.col("n_a") >= F.col("n_b") * like) & (F.col("n_b") >= F.col("n_a") * like)).select("rep_a", "rep_b").distinct()
    x, y = (grams.select(F.col("id").alias(f"rep_{k}"), F.col("grams").alias(f"g_{k}")) for k in "ab")
    both = F.size(F.array_intersect("g_a", "g_b"))
    return members, near.join(x, "rep_a").join(y, "rep_b").where(both >= like * (F.size("g_a") + F.size("g_b") - both)).select("rep_a", "rep_b")


def links(records: DataFrame, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, rep) of each record that takes part, and (rep_a, rep_b) of the classes that are alike."""
    found = classes(records)
    reps = found.groupBy("one", "two").agg(F.min("id").alias("id"), F.min_by(F.struct(*_BITS, "bands"), "id").alias("x"))
    reps = cut(reps.select("one", "two", "id", "x.*"), freed=True)
    members = found.select("id", "one", "two").distinct().join(reps.select(F.col("id").alias("rep"), "one", "two"), ["one", "two"]).select("id", "rep")
    hot, n = _hot(reps), BANDS // ROUNDS
    # some bands at a time, as the keyed rows of all are several times the input
    rounds = [_blocks(reps, hot, k, n).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_join_rows, "id_a long, id_b long") for k in range(0, BANDS, n)]
    near = reduce(DataFrame.union, [cut(x, freed=True) for x in rounds]).distinct()
    near = cut(_may_be_alike(near, found, like), freed=True)
    alike = with_likeness(near, records).where(F.col("likeness") >= like)
    return members, alike.select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b")).distinct()


def pairs(records: DataFrame, like: float = LIKE, exact: bool = False) -> DataFrame:
    """(id_a, id_b) of all records that are alike, copies included."""
    members, between = (exact_links if exact else links)(records, like)
    members = cut(members)
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).where("id_a < id_b").select("id_a", "id_b")
    across = between.join(a, "rep_a").join(b, "rep_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return within.unionByName(across)


def groups(records: DataFrame, like: float = LIKE) -> DataFrame:
    """(id, group) of all records that are alike with another: the connected parts of the pairs, named by their smallest id."""
    members, between = links(records, like)
    members = cut(members)
    parts = components(cut(between.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))).select(F.col("id").alias("rep"), "part")
    copied = members.groupBy("rep").agg(F.count("*").alias("rows"))
    rows = members.join(copied, "rep").join(parts, "rep", "left").where("rows > 1 or part is not null")
    return rows.select("id", F.coalesce("part", "rep").alias("group"))
