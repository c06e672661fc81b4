"""Mixing sources to target weights in tokens of a public tokenizer, by hierarchical budgets.

The leaves of a mix are the parts of its sources by language; the tree is domain (the kind of the source), language,
source. A source's weight is spread over its languages by their tokens, and a mix's budget goes down the tree by the weights of
what lies below each node. A leaf gives at most its tokens times max_repeats; what it can't give is shared out by weight among
its siblings (other sources of that language and domain) first, then among the other languages of the domain, then among the domains,
until it is placed or nothing can give more.

A leaf's share is taken in seeded epochs: each epoch orders the leaf's documents anew by hash, whole epochs are taken
whole, and of the last one the prefix whose tokens fit. Prefix sums are taken over hash slices first and within the one
slice where the prefix ends after that, so no task holds a source.

The trees are as small as mix_targets times the languages, which is configuration; only the token sums of each leaf are brought together for them.

Defined results: null and empty documents have no tokens and aren't selected; documents without a source belong to none; documents without a
language are a language of their own, ''; a source without documents gives nothing and its share moves on; null or negative
weights count as 0 and a null max_repeats as 1; equal hashes are ordered by doc_id; repeated target rows of one mix and source
add up; without a total, a mix is as large as what its weighted sources hold once, and a total that the sources can't reach gives all that they may
give; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.encoding import TOKENIZER, token_counts
from siftwell.session import cut

SEED = 20250101
SLICES = 4096
#: Leaves up to which their table is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def share_out(budget: float, children: list, weight, give) -> dict:
    """The budget dealt among children by weight, none above what it can give; what one can't give goes to the others."""
    got, left = dict.fromkeys(range(len(children)), 0.0), budget
    open_ = [k for k in got if weight(children[k]) > 0 and give(children[k]) > 0]
    while open_ and left > 1e-9:
        total = sum(weight(children[k]) for k in open_)
        full = [k for k in open_ if got[k] + left * weight(children[k]) / total >= give(children[k])]
        if not full:
            for k in open_:
                got[k] += left * weight(children[k]) / total
            break
        for k in full:
            left -= give(children[k]) - got[k]
            got[k] = give(children[k])
        open_ = [k for k in open_ if k not in full]
    return got


def budgets(leaves: Iterable[dict], total: float) -> dict:
    """{(domain, lang, source): tokens} for one mix; leaves: domain, lang, source, weight, most."""
    leaves = list(leaves)
    out: dict = {}

    def down(part: list[dict], amount: float, levels: tuple[str, ...]) -> None:
        groups: dict = defaultdict(list)
        for leaf in part:
            groups[leaf[levels[0]]].append(leaf)
        nodes = [groups[k] for k in sorted(groups)]
        got = share_out(amount, nodes, lambda n: sum(x["weight"] for x in n), lambda n: sum(x["most"] for x in n if x["weight"] > 0))
        for k, node in enumerate(nodes):
            if levels[1:]:
                down(node, got[k], levels[1:])
            else:
                out[(node[0]["domain"], node[0]["lang"], node[0]["source"])] = got[k]

    down(leaves, total, ("domain", "lang", "source"))
    return out


def counted(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, tokens) of the documents with tokens of the sources that some mix names, kept in the shared folder."""
    named = targets.select("source").where("source is not null").distinct()  # configuration: a row a target at most
    docs = documents.select("doc_id", "text", "source", "lang").where("text != ''").join(named, "source", "left_semi")
    return cut(token_counts(docs.select("doc_id", "text", "source", "lang"), tokenizer).where("tokens > 0"))


def plan(docs: DataFrame, targets: DataFrame, sources: DataFrame, total: int | None = None) -> DataFrame:
    """A row a mix, source and language: its place in the tree, what it has, its target share, its budget, and its whole epochs.

    total: the tokens of each mix; without it, what the mix's weighted sources hold once.
    """
    spark = docs.sparkSession
    goals = targets.where("mix is not null and source is not null").groupBy("mix", "source").agg(
        F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats")
    )
    have = docs.groupBy("source", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sum("tokens").alias("tokens"))
    kinds = sources.groupBy(F.col("id").alias("source")).agg(F.max("type").alias("domain"))
    rows = goals.join(have, "source", "left").join(kinds, "source", "left").collect()  # a row a target and language
    mixes: dict = defaultdict(list)
    held: dict = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["mix"], r["source"], r["lang"] or "")):
        tokens = int(r["tokens"] or 0)
        held[r["mix"], r["source"]] += tokens
        mixes[r["mix"]].append({"mix": r["mix"], "source": r["source"], "domain": r["domain"] or "", "lang": r["lang"] or "", "goal": float(r["weight"]), "tokens": tokens, "max_repeats": int(r["max_repeats"]), "most": tokens * int(r["max_repeats"])})
    out = []
    for leaves in mixes.values():
        for x in leaves:
            whole = held[x["mix"], x["source"]]
            x["weight"] = x["goal"] * (x["tokens"] / whole if whole else 1.0)
        amount = sum(x["tokens"] for x in leaves if x["goal"] > 0) if total is None else total
        weights = sum(x["weight"] for x in leaves)
        got = budgets(leaves, amount)
        for x in leaves:
            b = int(got.get((x["domain"], x["lang"], x["source"]), 0.0) + 1e-6)
            epochs = b // x["tokens"] if x["tokens"] else 0
            out.append((x["mix"], x["source"], x["domain"], x["lang"], x["weight"] / weights if weights else 0.0, x["tokens"], x["max_repeats"], b, epochs, b - epochs * x["tokens"]))
    leaves = spark.createDataFrame(out, "mix string, source string, domain string, lang string, target_share double, tokens long, max_repeats int, budget long, epochs long, rest long")
    return F.broadcast(leaves) if len(out) <= BROADCAST_ROWS else leaves


def _prefix(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """(mix, source, lang, epoch, doc_id, tokens) of the last, broken epoch of each leaf."""
    leaf = ["mix", "source", "lang"]
    seeded = F.xxhash64(F.lit(SEED), F.col("mix"), F.col("epoch"), F.col("doc_id"))
    broken = leaves.where("rest > 0").select(*leaf, (F.col("epochs") + 1).alias("epoch"), "rest")
    rows = docs.join(broken, ["source", "lang"]).withColumn("h", seeded)
    rows = rows.withColumn("slice", F.shiftrightunsigned("h", 52).cast("int"))
    sums = rows.groupBy(*leaf, "slice").agg(F.sum("tokens").alias("t"))
    before = sums.selectExpr(*leaf, "slice", "t", f"sum(t) over (partition by mix, source, lang order by slice rows between {SLICES} preceding and 1 preceding) as head")
    rows = rows.join(before.withColumn("head", F.coalesce("head", F.lit(0))), [*leaf, "slice"]).where("head < rest")
    inside = rows.where("head + t <= rest")
    edge = rows.where("head + t > rest").selectExpr("*", "sum(tokens) over (partition by mix, source, lang order by h, doc_id rows unbounded preceding) as run").where("head + run <= rest")
    return inside.select(*leaf, "epoch", "doc_id", "tokens").unionByName(edge.select(*leaf, "epoch", "doc_id", "tokens"))


def _chosen(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), "tokens")
    whole = leaves.where("epochs > 0").select("mix", "source", "lang", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch"))  # at most max_repeats a leaf
    full = docs.join(whole, ["source", "lang"]).select("mix", "source", "lang", "epoch", "doc_id", "tokens")
    return full.unionByName(_prefix(docs, leaves))


def _by_source(leaves: DataFrame, taken: DataFrame) -> DataFrame:
    """A row a mix, domain and source: sums of the leaves and of what was taken, and the actual share."""
    goals = leaves.groupBy("mix", "domain", "source").agg(F.sum("tokens").alias("tokens"), F.max("max_repeats").alias("max_repeats"), F.sum("target_share").alias("target_share"), F.sum("budget").alias("budget"))
    got = taken.groupBy("mix", "source").agg(F.sum("tokens").alias("taken"), F.count("*").alias("picks"), F.max("epoch").alias("repeats"))
    rows = goals.join(got, ["mix", "source"], "left").na.fill(0, ["taken", "picks", "repeats"])
    whole = rows.groupBy("mix").agg(F.sum("taken").alias("whole"))
    return rows.join(whole, "mix").withColumn("actual_share", F.when(F.col("whole") > 0, F.col("taken") / F.col("whole")).otherwise(0.0)).drop("whole")


def selected(documents: DataFrame, targets: DataFrame, sources: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None) -> DataFrame:
    """What each mix takes, a row each time a document is taken: mix, domain, lang, source, epoch, doc_id, tokens, and beside it
    the target and the actual share of its source in the mix."""
    docs = counted(documents, targets, tokenizer)
    leaves = plan(docs, targets, sources, total)
    taken = cut(_chosen(docs, leaves))
    shares_ = _by_source(leaves, taken).select("mix", "source", "domain", "target_share", "actual_share")  # a row a target
    return taken.join(shares_, ["mix", "source"]).select("mix", "domain", "lang", "source", "epoch", "doc_id", "tokens", "target_share", "actual_share")


def shares(documents: DataFrame, targets: DataFrame, sources: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None) -> DataFrame:
    """A row a mix and source: target and actual share of the mix's tokens, what was budgeted and taken, and how often."""
    docs = counted(documents, targets, tokenizer)
    leaves = plan(docs, targets, sources, total)
    return _by_source(leaves, _chosen(docs, leaves)).select("mix", "domain", "source", "tokens", "max_repeats", "target_share", "budget", "taken", "actual_share", "picks", "repeats")
