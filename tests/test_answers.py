import json

from pyspark.sql import functions as F

from siftwell.operators import answers


def test_round(spark):
    rows = spark.createDataFrame([(i, f"t{i}", f"k{i}") for i in range(1, 8)], "id long, title string, cache_key string")
    cache = spark.createDataFrame([("k1", "old", 1), ("k1", "yes", 2), ("x", "no", 1)], "cache_key string, decision string, created_at int")
    known, new = answers.known_and_new(rows, cache)
    assert [(r["id"], r["decision"]) for r in known.collect()] == [(1, "yes")] and new.count() == 6
    batched = answers.batches(new, 4)
    assert sorted((r["batch"], r["count"]) for r in batched.groupBy("batch").count().collect()) == [(0, 4), (1, 2)]

    def service(batch):
        if any(b["id"] == 7 for b in batch):
            raise RuntimeError("busy")
        return "```json\n" + json.dumps({"items": [{"id": str(b["id"]), "ok": b["id"] % 2 == 0, "p": 0.5} for b in batch]}) + "\n```"

    said = answers.ask(batched, service, ["id", "title"])
    assert sorted((r["batch"], r["error"]) for r in said.collect()) == [(0, None), (1, "RuntimeError: busy")]
    got = answers.parsed(said, {"id": "string", "ok": "boolean", "p": "number"}, exact=True)
    assert sorted((r["id"], r["ok"]) for r in got.where("valid").collect()) == [("2", True), ("3", False), ("4", True), ("5", False)]
    faults = answers.unmatched(batched.select("batch", F.col("id").cast("string").alias("id")), got.where("valid"))
    assert sorted((r["id"], r["fault"]) for r in faults.collect()) == [("6", "missing"), ("7", "missing")]


def test_strict_shapes(spark):
    cases = [
        ('[{"id":"a","ok":true}]', True), ('[{"id":"a","ok":1}]', False), ('[{"id":1,"ok":true}]', False), ('[{"id":"a"}]', False), ('[{"id":"a","ok":true,"more":1}]', False), ("[3]", False), ("not json", False), (None, False), ("{}", False),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "batch long, content string")
    got = {r["batch"]: r["valid"] for r in answers.parsed(df, {"id": "string", "ok": "boolean"}, exact=True).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}
    assert answers.parsed(df, {"id": "string", "ok": "boolean"}).where("valid").count() == 2


def test_faults(spark):
    asked = spark.createDataFrame([(0, "a"), (0, "b")], "batch long, id string")
    told = spark.createDataFrame([(0, "a"), (0, "a"), (0, "z")], "batch long, id string")
    assert sorted((r["id"], r["fault"]) for r in answers.unmatched(asked, told).collect()) == [("a", "repeated"), ("b", "missing"), ("z", "unknown")]
