import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftwell.llm import encoding

TEXTS = ["Hello world, it's 2025!  two  spaces\n\nlines\r\n", "机器人测试。", "", None, " ", "é é 🤖🤖 <|endoftext|>", "x" * 3000, "tab\t\tend   ", "\n\n  a", "123456 ''s 'll", "​ 　z"]


def frame(spark, texts):
    return spark.createDataFrame([(i * 3000, t, "clash", "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, block string, word string, ids string")


def whole(text):
    return encoding.tokenizer(encoding.TOKENIZER).encode_ordinary(text) if text else []


def test_against_the_tokenizer(spark):
    got = {r["doc_id"]: list(r["ids"]) for r in encoding.encode(frame(spark, TEXTS)).collect()}
    assert got == {i * 3000: whole(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=60)), min_size=1, max_size=10))
def test_round_trip(spark, texts):
    encoded = encoding.encode(frame(spark, texts))
    got = {r["doc_id"]: r["text"] for r in encoding.decode(encoded).collect()}
    assert got == {i * 3000: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: list(r["ids"]) for r in encoded.collect()} == {i * 3000: whole(t) for i, t in enumerate(texts)}


def test_repeated_rows_and_empty(spark):
    df = frame(spark, ["a b"])
    assert encoding.encode(df.union(df)).count() == 2 and encoding.encode(df.limit(0)).count() == 0


def test_counts(spark):
    got = {r["doc_id"]: r["tokens"] for r in encoding.token_counts(frame(spark, TEXTS).select("doc_id", "text", "block")).collect()}
    assert got == {i * 3000: len(whole(t)) for i, t in enumerate(TEXTS)}


def test_decoding_of_odd_lists(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [220])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in encoding.decode(df).collect()} == {1: "", 2: None, 3: " "}


def test_vocabulary_is_named_by_path(spark):
    with pytest.raises(FileNotFoundError):
        encoding.ranks("/nowhere")


@pytest.mark.parametrize("ids", [lambda k: k * 9_000_000_001, lambda k: hash((k, "x")), lambda k: None, lambda k: 7])
def test_sparse_hashed_null_and_equal_ids(spark, monkeypatch, ids):
    texts = [f"doc {k} says {'word ' * (k % 9)}{k * k}" for k in range(300)] + [None, ""]
    df = spark.createDataFrame([(ids(k), t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encoding.encode(df).collect())
    assert got == sorted((str(ids(k)), whole(t)) for k, t in enumerate(texts))


def test_pieces_chunks_and_long_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encoding, "CHUNK", 64)
    monkeypatch.setattr(encoding, "PIECE", 200)
    monkeypatch.setattr(encoding, "LONG", 2000)
    texts = ["a b c " * 5, "x y " * 900, None, "", "the end " * 40, "z " * 64, "q"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    told = pa.Table.from_batches(encoding._answer(encoding.TOKENIZER)(encoding._explode(iter([batch]))))
    pieces = sorted(set(told.column("piece").to_pylist()))
    assert len(pieces) > 3
    found = {}
    for p in pieces:
        own = told.filter(pa.compute.equal(told.column("piece"), p))
        out = encoding._assemble(encoding._id_type(encoding.TOKENIZER))(own)
        found |= dict(zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), strict=True))
        with pytest.raises(ValueError):
            encoding._assemble(encoding._id_type(encoding.TOKENIZER))(pa.concat_tables([own, own]))
    assert found == {k: whole(t) for k, t in enumerate(texts)}
