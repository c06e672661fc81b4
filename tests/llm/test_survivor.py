from siftwell.llm import survivor

SOURCES = [("s", "UTC")]
SCHEMA = "id long, source_id string, cluster_key string, source_tier int, summary string, published_at string, metadata_json string, title string, category string, tier string, length string, utc_us string"


def frame(spark, rows):
    return spark.createDataFrame([(i, "s", k, t, s, p, m, f"t{i}", c, "clash", "clash", "clash") for i, k, t, s, p, m, c in rows], SCHEMA), spark.createDataFrame(SOURCES, "id string, time_zone string")


def test_best_fields(spark):
    rows = [
        (1, " ABC", 3, "A short one.", "2025-01-01T00:00:00Z", None, "x"), (2, "abc ", 0, "A somewhat longer one.", "2025-01-03T00:00:00Z", None, "x"), (3, "Abc", 1, "The longest one of them all was cut...", None, None, "x"),
        (4, "alone", 1, "Text.", "2025-01-01T00:00:00Z", None, "x"), (5, "empty", None, None, None, None, None), (6, "EMPTY", 99, " ", "soon", None, None), (7, None, 1, "Text.", None, None, "x"), (8, "  ", 1, "Text.", None, None, "x"), (8, "  ", 1, "Text.", None, None, "x"),
    ]
    got = {tuple(r) for r in survivor.best_fields(*frame(spark, rows)).collect()}
    assert got == {("abc", "source_tier", 3), ("abc", "summary", 2), ("abc", "published_at", 2)}
    assert survivor.best_fields(*frame(spark, rows[:1])).count() == 0
    items, sources = frame(spark, rows)
    assert survivor.best_fields(items.limit(0), sources).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i // 2}", 1 + i % 3, "x" * (1 + i), f"2025-01-{1 + i % 28:02d}T00:00:{i % 60:02d}Z", None, "c") for i in range(600)]
    got = {(r["cluster_key"], r["field"]): r["id"] for r in survivor.best_fields(*frame(spark, rows)).collect()}
    assert got["hot", "source_tier"] == 0 and got["hot", "summary"] == 597


def test_current_values_without_timestamps(spark):
    rows = []
    for g in range(5):  # taught: draft, then review, then final
        rows += [(g * 10 + k, f"g{g}", f"2025-01-0{k + 1}T00:00:00Z", v) for k, v in enumerate(("draft", "review", "final"))]
    rows += [(100, "h", None, "review"), (101, "h", None, "draft"), (102, "i", "2025-01-09T00:00:00Z", "draft"), (103, "i", None, "review"), (104, "j", "2025-01-02T00:00:00Z", "final"), (105, "j", "2025-01-03T00:00:00Z", "draft"), (106, "k", None, "unseen")]
    values = spark.createDataFrame(rows, "id long, cluster_key string, at string, value string").selectExpr("cluster_key", "'status' as field", "value", "id", "unix_micros(to_timestamp(at)) as utc_us")
    got = {r["cluster_key"]: r["value"] for r in survivor.current_values(values).collect()}
    assert got["h"] == "review" and got["i"] == "review" and got["j"] == "draft" and got["k"] == "unseen" and got["g0"] == "final"
    learned = {(r["before"], r["after"]) for r in survivor.transitions(values).collect()}
    assert learned == {("draft", "review"), ("review", "final")}


def test_current_values_when_a_group_skips_a_step(spark):
    rows = []
    for g in range(5):  # taught: draft, review, final by single steps, and a cycle of x, y, z that out follows
        rows += [(g * 10 + k, f"g{g}{k // 2}", f"2025-01-0{k + 1}T00:00:00Z", v) for k, v in enumerate(("draft", "review"))]
        rows += [(g * 10 + k, f"h{g}", f"2025-01-0{k + 1}T00:00:00Z", v) for k, v in enumerate(("review", "final"), 3)]
        for n, (a, b) in enumerate(("xy", "yz", "zx", ("z", "out"))):
            rows += [(1000 + g * 10 + n, f"{n}c{g}", "2025-01-01T00:00:00Z", a), (2000 + g * 10 + n, f"{n}c{g}", "2025-01-02T00:00:00Z", b)]
    rows += [(100, "untimed", None, "draft"), (101, "untimed", None, "final"), (102, "beside", "2025-01-09T00:00:00Z", "draft"), (103, "beside", None, "final"), (104, "timed", "2025-01-02T00:00:00Z", "final"), (105, "timed", "2025-01-03T00:00:00Z", "draft")]
    rows += [(106, "cycle", None, "z"), (107, "cycle", None, "y"), (108, "cycle", None, "x"), (109, "left", None, "x"), (110, "left", None, "out"), (111, "apart", None, "x"), (112, "apart", None, "draft")]
    values = spark.createDataFrame(rows, "id long, cluster_key string, at string, value string").selectExpr("cluster_key", "'status' as field", "value", "id", "unix_micros(to_timestamp(at)) as utc_us")
    got = {r["cluster_key"]: r["value"] for r in survivor.current_values(values).collect()}
    assert {k: got[k] for k in ("untimed", "beside", "timed", "cycle", "left", "apart")} == {"untimed": "final", "beside": "final", "timed": "draft", "cycle": "z", "left": "out", "apart": "x"}
    order = {(r["before"], r["after"]) for r in survivor.reachable(survivor.transitions(values)).collect()}
    assert order == {("draft", "review"), ("review", "final"), ("draft", "final"), *((v, "out") for v in "xyz")}


def test_records(spark):
    rows = [(1, "a", 2, "Short.", "2025-01-01T00:00:00Z", None, "old"), (2, "A", 1, "Longer text.", "2025-02-01T00:00:00Z", '{"llm_screening":{"prompt_version":"v6"}}', "new"), (3, "b", None, None, None, None, None)]
    got = {r["cluster_key"]: r.asDict() for r in survivor.records(*frame(spark, rows)).collect()}
    assert got["a"] == {"cluster_key": "a", "members": 2, "source_tier": 1, "summary": "Longer text.", "published_ms": 1738368000000, "title": "t2", "category": "new", "prompt_version": "v6"}
    assert got["b"]["members"] == 1 and got["b"]["source_tier"] is None and got["b"]["title"] == "t3"


def test_transitions_by_days_are_those_of_whole_groups(spark):
    import random

    rng, day = random.Random(8), 86_400_000_000
    rows = [(f"k{g}", "f", f"v{v}", 10 * g + i, rng.randrange(0, 6) * day + rng.randrange(day)) for g in range(40) for i, v in enumerate(rng.sample(range(6), 5))]
    rows += [("hot", "f", f"v{v}", 1000 + v, v * day // 3) for v in range(6)]
    got = {(r["before"], r["after"]) for r in survivor.transitions(spark.createDataFrame(rows, "cluster_key string, field string, value string, id long, utc_us long")).collect()}
    counts = {}
    for g in {r[0] for r in rows}:
        order = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[4], r[2]))]
        for a, b in zip(order, order[1:], strict=False):
            counts[a, b] = counts.get((a, b), 0) + 1
    assert got == {(a, b) for (a, b), n in counts.items() if n >= survivor.SEEN and n >= survivor.OFTENER * counts.get((b, a), 0)} and got
