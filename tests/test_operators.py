import random
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text
from siftwell.operators import checks, cluster, dedup, intervals, reads, store
from siftwell.session import scratch_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def fold(items):
    """The champion of each key and what it displaced, one record after another."""
    best = {}
    for i in items:
        if i["key"] not in best:
            best[i["key"]] = (i, [])
            continue
        champion, lost = best[i["key"]]
        rank = lambda x: (x["tier"], -len(x["summary"]), x["at"])
        best[i["key"]] = (i, [champion["id"]]) if rank(i) < rank(champion) else (champion, [*lost, i["id"]])
    return best


def test_dedup_against_a_fold(spark):
    rng = random.Random(1)
    items = [{"id": i, "key": f"k{rng.randrange(40)}", "tier": rng.randrange(3), "summary": "x" * rng.randrange(3), "at": datetime(2025, 1, rng.randrange(1, 5))} for i in range(300)]
    df = spark.createDataFrame([(i["id"], i["key"], i["tier"], i["summary"], i["at"]) for i in items], "id long, key string, tier int, summary string, at timestamp")
    df = df.select("id", "key", dedup.preference(F.col("tier"), F.col("summary"), F.col("at"), F.col("id")).alias("rank"))
    want = fold(items)
    assert {r["key"]: r["winner"] for r in dedup.winners(df).collect()} == {k: v[0]["id"] for k, v in want.items()}
    lost = {}
    for r in sorted(dedup.alternates(df).collect(), key=lambda r: (r["place"], r["alternate"])):
        lost.setdefault(r["winner"], []).append(r["alternate"])
    assert lost == {v[0]["id"]: v[1] for v in want.values() if v[1]}
    assert dedup.winners(df.limit(0)).count() == 0


def test_signals_are_merged_once(spark):
    df = spark.createDataFrame([("k", 2, 0, "a", "u", None, 5), ("k", 1, 0, "a", "u", "", 7), ("k", 1, 1, "b", "u", None, 1)], "key string, id long, pos int, platform string, discussion string, period string, points int")
    assert sorted((r["platform"], r["points"]) for r in dedup.merged_signals(df).collect()) == [("a", 7), ("b", 1)]


def headlines(seed=1, n=70):
    rng = random.Random(seed)
    base = [["model", "beats", "experts", "chess", "tournament"], ["robot", "folds", "laundry", "home", "trial"], ["agency", "opens", "data", "centre", "north"], ["机", "器", "人", "测", "试", "完", "成"], ["tiny", "chip"]]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(["record", "again", "新"])
        out.append((i, " ".join(words), datetime(2025, 1, rng.randrange(1, 20), rng.randrange(24)), rng.randrange(1, 4), rng.randrange(100)))
    return out


def test_clusters_against_one_global_fold(spark):
    data = headlines() + [(900, "", datetime(2025, 1, 1), 1, 1), (901, "model beats experts chess tournament", None, 1, 1)]
    df = spark.createDataFrame(data, "id long, title string, at timestamp, tier int, length int")
    got = {r["id"]: r["representative"] for r in cluster.clusters(df).collect()}
    n = cluster.titled(df).toPandas().set_index("id")
    from difflib import SequenceMatcher

    def similar(a, b):
        x, y = n.loc[a], n.loc[b]
        if not x.normal or not y.normal:
            return False
        if x.normal == y.normal:
            return True
        s, t, r = set(x.tokens), set(y.tokens), SequenceMatcher(None, x.normal, y.normal).ratio()
        return (r if min(len(s), len(t)) < 3 else 0.7 * len(s & t) / len(s | t) + 0.3 * r) >= 0.72

    # the definition: from the latest to the earliest, each joins the first cluster whose representative of the moment is near and similar
    heads, member = [], {}
    for i, _, a, tier, k in sorted((x for x in data if x[2]), key=lambda x: (-x[2].timestamp(), x[0])):
        rank = (tier, -k, a)
        c = next((c for c, (j, (_, _, at)) in enumerate(heads) if abs((at - a).total_seconds()) <= 3 * 86_400 and similar(i, j)), len(heads))
        member[i] = c
        heads[c:c] = [(i, rank)] if c == len(heads) else []
        heads[c] = min(heads[c], (i, rank), key=lambda h: h[1])
    want = {i: heads[c][0] for i, c in member.items()} | {901: 901}
    assert got == want and len(set(want.values())) < len(want)


def test_merged_clusters(spark):
    clustered = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 4)], "id long, representative long")
    records = spark.createDataFrame([(1, "s", ["x", "y"]), (2, "s", ["z", "x"]), (3, "t", None), (4, "s", ["q"])], "id long, source_id string, tags array<string>")
    (r,) = cluster.merged(clustered, records).collect()
    assert (r["representative"], r["size"], r["sources"], r["alternates"], r["tags"]) == (2, 3, 2, [1, 3], ["z", "x", "y"])


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (20, 21), (5, 4), *((k, k + 1) for k in range(100, 130))], "a long, b long")
    got = {r["id"]: r["part"] for r in cluster.components(edges).collect()}
    assert {got[k] for k in (1, 2, 3, 9)} == {1} and got[21] == 20 and got[5] == 4 and {got[k] for k in range(100, 131)} == {100}


def test_interval_join(spark):
    spans = spark.createDataFrame([(1, datetime(2025, 1, 1), datetime(2025, 1, 4)), (2, datetime(2025, 1, 4), datetime(2025, 1, 4, 6)), (3, None, None), (4, datetime(2025, 1, 2), datetime(2025, 1, 2))], "k int, s timestamp, e timestamp")
    points = spark.createDataFrame([(1, datetime(2025, 1, 1)), (2, datetime(2025, 1, 3, 23)), (3, datetime(2025, 1, 4)), (4, datetime(2025, 1, 4, 6)), (5, None)], "id int, t timestamp")
    got = {(r["id"], r["k"]) for r in intervals.within(points, F.col("t"), spans, "s", "e", how="left").collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, None), (5, None)}


ITEMS = "id long, kind string, title string, summary string, tags array<string>, category string, score double, is_important boolean, published_at string, metadata_json string"


def items(spark):
    data = [
        (1, "news", "Robot 50%", None, ["a_b"], "x", 1.0, True, "2025-01-01T00:00:00+00:00", '{"a":{"ok":true}}'), (2, "news", "Other", "robot", None, "y", 2.0, False, "2025-01-02T00:00:00+00:00", '{"a":{"ok":1}}'),
        (3, "paper", None, None, [], "x", 3.0, True, "2025-01-02T00:00:00+00:00", "broken"), (4, "paper", "aXb", "50", ["q"], None, None, None, "2025-13-99T00:00:00+00:00", None),
    ]
    return spark.createDataFrame(data, ITEMS)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_scan_and_top(spark):
    df = items(spark)
    assert ids(reads.top(reads.scan(df), 10)) == [3, 2, 1, 4]
    assert ids(reads.scan(df, "news", needle="ROBOT")) == [1, 2] and ids(reads.scan(df, needle="0%")) == [1] and ids(reads.scan(df, needle="a_b")) == [1]
    assert ids(reads.scan(df, since=datetime(2025, 1, 2, tzinfo=UTC))) == [2, 3] and ids(reads.scan(df, before=datetime(2025, 1, 2, tzinfo=UTC))) == [1]
    assert ids(reads.scan(df, json_equals={"$.a.ok": "true"})) == [1] and ids(df.where(reads.json_true("metadata_json", "$.a.ok"))) == [1]
    assert reads.top(df.withColumn("at", F.lit(None)), 0).count() == 1


def test_latest_and_stats(spark):
    feedback = spark.createDataFrame([(1, 1, "read", datetime(2025, 1, 1)), (2, 1, "saved", datetime(2025, 1, 1)), (3, 9, "read", datetime(2025, 1, 2)), (4, None, "read", datetime(2025, 1, 2))], "id long, item_id long, value string, created_at timestamp")
    assert {r["id"]: r["feedback_value"] for r in reads.with_feedback(items(spark), feedback).collect()} == {1: "saved", 2: None, 3: None, 4: None}
    assert reads.stats(items(spark)).first().asDict() == {"total": 4, "news": 2, "papers": 2, "important": 2}
    assert reads.stats(items(spark).limit(0)).first().asDict() == {"total": 0, "news": 0, "papers": 0, "important": 0}


@pytest.mark.parametrize("slice_ids", [3, 1 << 16])
def test_running_and_numbering(spark, slice_ids):
    rng = random.Random(2)
    data = [(i, rng.choice("ab"), rng.randrange(10)) for i in rng.sample(range(40), 25)]
    df = spark.createDataFrame(data, "id long, k string, v long")
    want = {i: sum(w for j, l, w in data if l == k and j < i) for i, k, v in data}
    assert {r["id"]: r["v_before"] for r in reads.running_before(df, "k", "id", ["v"], slice_ids).collect()} == want
    assert {r["id"]: r["n"] for r in reads.numbered(df, "id", slice_ids).collect()} == {i: k for k, i in enumerate(sorted(i for i, _, _ in data), 1)}
    best = {i for k in "ab" for i in [i for i, l, v in sorted(data, key=lambda r: (-r[2], r[0])) if l == k][:4]}
    assert {r["id"] for r in reads.flag_top(df, "k", "v desc, id", 4, 3).collect() if r["chosen"]} == best


def test_heat(spark):
    cases = [(4, 120, 0, 30, 100, None, True), (7, 495, 2, 20, 50, 30, True), (31, 999, 99, 30, 1, 1, False), (3, 0, 0, 10, None, None, True), (3, 0, 0, None, None, None, False), (3, 5, 5, None, 10, 10, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r int, p int, c int, l int, mp int, mc int, want boolean")
    assert df.where(reads.heat_qualified(*(F.col(x) for x in ("r", "p", "c", "l", "mp", "mc"))) != F.col("want")).count() == 0


def test_health(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 2), True, True), (datetime(2024, 12, 1), True, True), (None, True, True), (datetime(2025, 1, 2), False, True)], "checked_at timestamp, success boolean, domain_match boolean")
    assert reads.health(df, F.lit(datetime(2025, 1, 2, 12))).first().asDict() == {"healthy": 1, "stale": 2, "sources": 4}


ROWS = "id long, kind string, url string, title string, created_at int, updated_at int"


def test_upsert(spark):
    current = spark.createDataFrame([(1, "n", "a", "old", 1, 1), (2, "n", None, "keyless", 1, 1)], ROWS)
    changes = spark.createDataFrame([(7, "n", "a", "newer", 5, 5), (8, "n", "a", "new", 4, 4), (9, "p", "a", "other", 6, 6), (10, "n", None, "keyless too", 6, 6)], ROWS)
    got = rows(store.upsert(current, changes, ["kind", "url"]))
    assert got == sorted([(1, "n", "a", "newer", 1, 5), (2, "n", None, "keyless", 1, 1), (9, "p", "a", "other", 6, 6), (10, "n", None, "keyless too", 6, 6)], key=repr)


def test_table_versions(spark):
    t = store.Table(spark, scratch_path(spark, "table"), ["kind", "url"], 4)
    a = spark.createDataFrame([(1, "n", "a", "old", 1, 1)], ROWS)
    assert (t.version(), t.merge(a), t.version()) == (0, 1, 1)
    assert t.merge(spark.createDataFrame([(5, "n", "a", "new", 2, 2)], ROWS), "once") == t.merge(spark.createDataFrame([(6, "n", "z", "not again", 2, 2)], ROWS), "once") == 2
    kept = [b for b, f in t.manifest()["folders"].items() if f == t.manifest(1)["folders"].get(b)]
    assert len(kept) == len(t.manifest()["folders"]) - 1 or len(t.manifest(1)["folders"]) == 1  # only the bucket that was touched is written
    assert t.version() == 2 and rows(t.read()) == [(1, "n", "a", "new", 1, 2)]
    t.append(a.withColumn("extra", F.lit("x")))
    assert t.version() == 3 and {r["extra"] for r in t.read().collect()} == {None, "x"} and rows(t.read(2)) == [(1, "n", "a", "new", 1, 2)]


def test_other_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, m string")
    assert rows(store.update_by_id(a, spark.createDataFrame([(2, "y")], "id long, m string"), "m")) == [(1, "x"), (2, "y")]
    with pytest.raises(KeyError):
        store.update_by_id(a, spark.createDataFrame([(3, "y")], "id long, m string"), "m")
    assert rows(store.delete_where(a, F.col("m") == "x")) == [(2, None)]
    assert rows(store.replace_keyed(a, spark.createDataFrame([(2, "z"), (3, "w")], "id long, m string"), "id")) == [(1, "x"), (2, "z"), (3, "w")]
    assert store.with_columns(a, {"m": ("string", ""), "n": ("int", 1)}).collect()[1].asDict() == {"id": 2, "m": "", "n": 1}
    assert rows(store.referencing(a, spark.createDataFrame([(1,)], "id long"), "id")) == [(1, "x")]


def test_checks(spark):
    pages = spark.createDataFrame([("a", 3, 2), ("a", 3, 1), ("b", 3, 2), ("c", 3, 1), ("c", 2, 2)], "g string, total int, n int")
    assert {r["g"]: r["complete"] for r in checks.declared_totals(pages, "g", "total", "n").collect()} == {"a": True, "b": False, "c": False}
    days = spark.createDataFrame([("a", "01"), ("a", "03"), ("b", "01"), ("c", "02")], "g string, d string")
    assert {r["g"]: r["state"] for r in checks.bracketed(days, "g", "d", "02").collect()} == {"a": "empty", "b": "unknown", "c": "present"}
    assert rows(checks.repeated_keys(days, ["g"])) == [("a", 2)]
    places = spark.createDataFrame([("p", 1, 5), ("p", 2, 4), ("p", 3, 4)], "g string, k int, d int")
    assert [r["k"] for r in checks.descending(places, "g", "k", "d").collect()] == [3]
    x, y = (spark.createDataFrame([(v,) for v in vs], "k string") for vs in (["a", "b", "b"], ["b", "c"]))
    assert rows(checks.key_sets_differ(x, y, "k")) == [("a", "left"), ("c", "right")]
    ok, no = checks.members(x, y, "k")
    assert rows(ok) == [("b",)] and rows(no) == [("a",)]


def test_carried_forward(spark):
    local, remote = (spark.createDataFrame(v, "d string, t long, c long") for v in ([("x", 5, 5)], [("x", 3, 9), ("y", 1, 0), ("z", 0, 0)]))
    assert rows(reads.carried_forward(local, remote, "d", ["t", "c"])) == [("x", 0, 4), ("y", 1, 0)]
    assert text.STOP_WORDS
