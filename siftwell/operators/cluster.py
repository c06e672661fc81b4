"""Stories that tell the same news within a few days: greedy clusters over similar titles.

The fold is order-dependent: records go from the latest to the earliest, each joins the first cluster whose
representative is near in time and similar in title, else opens one; a better record becomes the representative. A record can
only join through a pair that passes the test, so the fold is run within the connected parts of the graph of such pairs.

Pairs come from prefix filters, which lose none, and each is judged once, in both orders, as the sequence ratio isn't symmetric: a similarity of 0.72 needs a token likeness of 0.6 where both titles have three
tokens or more, and otherwise shared characters of 0.72 of both lengths. Elements are ordered rarest first, so that
records meet over rare ones, by slab of days.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import fingerprint, normalize_title, title_similarity, title_tokens
from siftwell.session import cut

THRESHOLD, DAYS = 0.72, 3
_DAY_US = 86_400_000_000


def titled(records: DataFrame) -> DataFrame:
    """records (id, title, at, tier, length) with `normal` and `tokens`."""
    return cut(records.withColumn("normal", normalize_title(F.col("title"))).withColumn("tokens", title_tokens(F.col("normal"), True)))


def _met(rows: DataFrame, elements: Column, share: float, asking: Column | None = None) -> DataFrame:
    """(a, b), a < b: records that may share the `share` of their elements' union, within DAYS of each other; only pairs with a record that asks."""
    sets = rows.select("id", "at", (F.lit(True) if asking is None else asking).alias("asks"), F.explode(F.array_distinct(elements)).alias("e"))
    frequent = sets.groupBy("e").agg(F.count("*").alias("n"))
    ranked = sets.join(frequent, "e").groupBy("id", "at", "asks").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("s"))  # the elements of one title
    prefix = F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * share).cast("int") + 1)
    ranked = ranked.select("id", "at", "asks", F.explode(prefix).alias("x")).select("id", "at", "asks", F.col("x.e").alias("e"))
    slab = F.floor(F.unix_micros("at") / (DAYS * _DAY_US)).cast("long")
    x = ranked.where("asks").select(F.col("id").alias("x"), F.col("at").alias("at_x"), "e", slab.alias("slab"))
    y = ranked.select(F.col("id").alias("y"), F.col("at").alias("at_y"), "e", F.explode(F.array(slab - 1, slab, slab + 1)).alias("slab"))
    near = F.abs(F.unix_micros("at_x") - F.unix_micros("at_y")) <= DAYS * _DAY_US
    return x.join(y, ["e", "slab"]).where("x != y").where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def judged_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, forth, back): pairs within DAYS, and whether a's title passes the test against b's, and b's against a's. rows: as of `titled`."""
    rows = rows.where("at is not null and normal != ''")
    few = F.size(F.array_distinct("tokens")) < 3
    by_tokens = _met(rows.where(~few), F.col("tokens"), (threshold - 0.3) / 0.7)
    letters = F.split("normal", "")
    count = lambda c: F.size(letters) - F.size(F.array_remove(letters, c))
    numbered = F.flatten(F.transform(F.array_distinct(letters), lambda c: F.transform(F.sequence(F.lit(1), count(c)), lambda k: F.concat(c, k.cast("string")))))
    by_letters = _met(rows, numbered, threshold / (2 - threshold), few)
    x, y = (rows.select(F.col("id").alias(k), F.col("normal").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}")) for k in "ab")
    pairs = by_tokens.unionByName(by_letters).distinct().join(x, "a").join(y, "b")
    forth = title_similarity(F.col("n_a"), F.col("t_a"), F.col("n_b"), F.col("t_b")) >= threshold
    back = title_similarity(F.col("n_b"), F.col("t_b"), F.col("n_a"), F.col("t_a")) >= threshold
    return pairs.select("a", "b", forth.alias("forth"), back.alias("back"))


def similar_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): pairs within DAYS whose titles pass the test in one order or the other. rows: as of `titled`."""
    return judged_pairs(rows, threshold).where("forth or back").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, part): the smallest id that each end of an edge is connected with, by label propagation with pointer jumping."""
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("part")))
    while True:
        lower = both.join(labels.select(F.col("x").alias("y"), "part"), "y").groupBy("x").agg(F.min("part").alias("p"))
        near = labels.join(lower, "x").select("x", F.least("part", "p").alias("p"))
        jump = near.join(labels.select(F.col("x").alias("p"), F.col("part").alias("pp")), "p", "left").select("x", F.least("p", F.coalesce("pp", "p")).alias("part"))
        after = cut(jump)
        if after.join(labels.withColumnRenamed("part", "old"), "x").where("part != old").isEmpty():
            return after.select(F.col("x").alias("id"), "part")
        labels = after


def fold(earlier: list[list[int]], rank: list[tuple]) -> list[int]:
    """The cluster of each record, by number. earlier: for each record, in order, the earlier ones that it is similar to and near; rank: lower is better.

    Only links are followed: a record looks up which of its earlier relatives are representatives just now, and joins the oldest of their clusters.
    """
    leads: dict[int, int] = {}  # representative -> cluster
    led_by: list[int] = []  # cluster -> representative
    member: list[int] = []
    for i, relatives in enumerate(earlier):
        open_to = [leads[j] for j in relatives if j in leads]
        mine = min(open_to, default=len(led_by))
        member.append(mine)
        if not open_to:
            led_by.append(i)
            leads[i] = mine
        elif rank[i] < rank[led_by[mine]]:
            leads[i] = leads.pop(led_by[mine])
            led_by[mine] = i
    return member


def _folded(p: pd.DataFrame) -> pd.DataFrame:
    """(id, representative, size) of one connected part: rows (id, at_us, tier, length, earlier)."""
    p = p.sort_values(["at_us", "id"], ascending=[False, True])
    place = {i: k for k, i in enumerate(p.id)}
    rank = list(zip(p.tier, -p.length, p.at_us, strict=True))
    p = p.assign(cluster=fold([[place[j] for j in x] if x is not None else [] for x in p.earlier], rank), best=rank)
    best: dict[int, int] = {}
    for k, c in enumerate(p.cluster):
        if c not in best or rank[k] < rank[best[c]]:
            best[c] = k
    ids = p.id.to_numpy()
    return pd.DataFrame({"id": ids, "representative": [ids[best[c]] for c in p.cluster], "size": p.groupby("cluster").id.transform("size").to_numpy()})


def clusters(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, representative, size, cluster_key) of each record (id, title, at, tier, length).

    Records without an instant or with an empty title stand alone; equal instants go by id. What a cluster's members bring along is put
    together by `merged`. The order of the fold matters within a connected part only, and links alone are taken there, no texts.
    """
    rows = titled(records.select("id", "title", "at", "tier", "length"))
    pairs = cut(judged_pairs(rows, threshold))
    parts = components(pairs.where("forth or back").select("a", "b"))
    at_a, at_b = (rows.select(F.col("id").alias(k), F.unix_micros("at").alias(f"at_{k}")) for k in "ab")
    ordered = pairs.join(at_a, "a").join(at_b, "b").withColumn("a_first", (F.col("at_a") > F.col("at_b")) | ((F.col("at_a") == F.col("at_b")) & (F.col("a") < F.col("b"))))
    links = ordered.where((F.col("a_first") & F.col("back")) | (~F.col("a_first") & F.col("forth")))  # the later record's title against the earlier one's
    links = links.select(F.when(F.col("a_first"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("a_first"), F.col("a")).otherwise(F.col("b")).alias("first"))
    links = links.groupBy("id").agg(F.collect_list("first").alias("earlier"))  # the similar titles of a few days
    grouped = rows.join(parts, "id").join(links, "id", "left").select("id", "part", "earlier", F.unix_micros("at").alias("at_us"), F.coalesce(F.col("tier").cast("int"), F.lit(9)).alias("tier"), F.coalesce(F.col("length").cast("int"), F.lit(0)).alias("length"))
    together = grouped.groupBy("part").applyInPandas(_folded, "id long, representative long, size long")
    alone = rows.join(parts, "id", "left_anti").select("id", F.col("id").alias("representative"), F.lit(1).cast("long").alias("size"))
    keys = rows.select(F.col("id").alias("representative"), fingerprint(F.col("normal"), F.col("tokens")).alias("cluster_key"))
    return together.unionByName(alone).join(keys, "representative").select("id", "representative", "size", "cluster_key")


def merged(clustered: DataFrame, records: DataFrame, most: int = 1000) -> DataFrame:
    """A row a cluster of more than one record: representative, size, how many sources tell it, its alternates and the tags of all, both in order.

    clustered: (id, representative); records: (id, source_id, tags). The representative comes first, then its alternates by id; lists hold at most `most`
    tags, as a page does, while the counts are of all members.
    """
    rows = clustered.select("id", "representative").join(records.select("id", "source_id", "tags"), "id")
    alternates = rows.where("id != representative").groupBy("representative").agg(F.array_sort(F.collect_list("id")).alias("alternates"))  # titles within a few days
    order = F.struct((F.col("id") != F.col("representative")).alias("later"), "id", "pos")
    tags = rows.select("representative", "id", F.posexplode("tags").alias("pos", "tag")).where("trim(tag) != ''").groupBy("representative", "tag").agg(F.min(order).alias("o"))
    tags = tags.groupBy("representative").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda t: t["tag"]), 1, most).alias("tags"))
    counts = rows.groupBy("representative").agg(F.count("*").alias("size"), F.count_distinct("source_id").alias("sources")).where("size > 1")
    return counts.join(alternates, "representative").join(tags, "representative", "left").select("representative", "size", "sources", "alternates", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
