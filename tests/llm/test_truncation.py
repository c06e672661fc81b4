import random

from siftwell.llm import truncation

SCHEMA = "id long, source_id string, summary string, tri long, pair long, w string, cut boolean"
SENTENCES = [
    "The team trained the planner on {} hours of recordings and kept {} for review.", "Reviewers asked for the notes to be published before {} adopts the system.", "Early testers measured fewer surprises at {} during the season.",
    "Shipments to {} begin with {} units and cover repairs for years.", "According to {} the new method cut the cost by {} percent.",
]
TAILS = ["", "", "", " (updated)", " Filed under: autonomy"]


def items(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, 1, "clash", None) for i, s, t in rows], SCHEMA)


def corpus(seed=1, n=1500):
    rng, rows, cut = random.Random(seed), [], set()
    name = lambda: rng.choice("BDGKLMPRTV") + "".join(rng.choice("aeiourlsk") for _ in range(5))
    for i in range(n):
        body = " ".join(s.format(*(rng.choice([name(), str(rng.randrange(99))]) for _ in range(s.count("{}")))) for s in rng.sample(SENTENCES, 3))
        text, source = body + rng.choice(TAILS), "cutting" if i % 3 == 0 else "whole"
        if source == "cutting" and rng.random() < 0.3:
            k = rng.randrange(len(body) // 2, len(body) - 12)
            if body[k - 1] not in ". " and body[k] != ".":
                text = body[:k].rstrip() + rng.choice(["", "", "...", "…", " [...]", "... Read more", "�", "&qu"])
                cut.add(i)
        rows.append((i, source, text))
    return rows, cut


def test_recall_and_precision(spark):
    rows, cut = corpus()
    got = {r["id"] for r in truncation.cut_records(items(spark, rows)).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.02 * len(got)


def test_rates_and_odd_rows(spark):
    rows, cut = corpus(2, 900)
    odd = [(10_000, "odd", None), (10_001, "odd", ""), (10_002, "odd", "  ​"), (10_003, "odd", "Comments"), (10_004, "odd", "n/a"), (10_005, "odd", "long " * 40_000 + "end."), (10_006, None, "It was measured at…"), rows[0]]
    df = items(spark, rows + odd)
    judged = {r["id"]: r["cut"] for r in truncation.judged(df).collect()}
    assert not {10_000, 10_001, 10_002} & set(judged) and not judged[10_003] and not judged[10_004] and judged[10_006]
    rates = {r["source_id"]: r["rate"] for r in truncation.cut_rates(df).collect()}
    assert 0.2 < rates["cutting"] < 0.4 and rates["whole"] < 0.02 and rates[None] == 1.0


def test_empty(spark):
    assert truncation.cut_records(items(spark, []).limit(0)).count() == 0 and truncation.cut_rates(items(spark, []).limit(0)).count() == 0
