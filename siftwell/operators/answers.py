"""Answers of an outside service to batches of records: batching, strict parsing, matching, and a keyed cache of what is known.

The service itself is injected; what it returns is only trusted after its shape, its types and its ids have been checked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import without_fence
from siftwell.operators.reads import numbered

#: JSON kinds as the types that a value may be of: a number is never a boolean, a boolean never a number.
KINDS = {"boolean": ("BOOLEAN",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "list": ("ARRAY",)}


def batches(rows: DataFrame, size: int, order: str = "id") -> DataFrame:
    """Rows with `batch`, from 0, of at most `size` rows by a unique integer order."""
    return numbered(rows, order).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("long")).drop("n")


def known_and_new(candidates: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(known, new): candidates with their cached decision, and those without one. cache: key, decision."""
    latest = cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("decision", "created_at").alias("decision")) if "created_at" in cache.columns else cache.select(key, "decision").dropDuplicates([key])
    return candidates.join(latest, key), candidates.join(latest.select(key), key, "left_anti")


def entries(content: Column) -> Column:
    """The elements of a JSON answer, as variants: of an array, or of an object's `items`; null where it's neither. A code fence is taken off."""
    doc = F.try_parse_json(without_fence(content))
    return F.coalesce(F.try_variant_get(doc, "$.items", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))


def _is(value: Column, path: str, kind: str) -> Column:
    found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    out = F.lit(False)
    for t in KINDS[kind]:
        out = out | F.startswith(found, F.lit(t))
    return F.coalesce(out, F.lit(False))


def parsed(answers: DataFrame, fields: dict[str, str], exact: bool = False) -> DataFrame:
    """(batch, fields..., valid) of the elements of answers (batch, content): a row an element.

    fields: {name: boolean | number | string | list}. `valid` tells that each is there and of its kind and, if exact, that there is no other.
    An answer that can't be read gives one row of nulls that isn't valid.
    """
    casts = {"boolean": "boolean", "number": "double", "string": "string", "list": "array<string>"}
    rows = answers.select("batch", F.explode_outer(entries(F.col("content"))).alias("v"))
    valid = F.col("v").isNotNull()
    for name, kind in fields.items():
        valid = valid & _is(F.col("v"), f"$.{name}", kind)
    if exact:
        keys = F.array_sort(F.json_object_keys(F.to_json("v")))
        valid = valid & F.coalesce(keys == F.array(*map(F.lit, sorted(fields))), F.lit(False))
    return rows.select("batch", *(F.try_variant_get("v", f"$.{n}", casts[k]).alias(n) for n, k in fields.items()), F.coalesce(valid, F.lit(False)).alias("valid"))


def unmatched(asked: DataFrame, answered: DataFrame, key: str = "id") -> DataFrame:
    """(batch, key, fault): ids asked for without an answer, answered without being asked for, or answered more than once."""
    a = asked.select("batch", key).distinct()
    b = answered.groupBy("batch", key).agg(F.count("*").alias("n"))
    rows = a.withColumn("asked", F.lit(True)).join(b, ["batch", key], "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return rows.select("batch", key, fault.alias("fault")).where("fault is not null")


def ask(batched: DataFrame, service: Callable[[list[dict]], str], columns: Sequence[str]) -> DataFrame:
    """(batch, content, error): what the service says to each batch; a failure is a row, not a failed job.

    A batch is at most as large as `batches` made it, so it fits a task.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        try:
            content, error = service(p[list(columns)].to_dict("records")), None
        except Exception as e:
            content, error = None, f"{type(e).__name__}: {e}"
        return pd.DataFrame({"batch": [p.batch.iat[0]], "content": [content], "error": [error]})

    return batched.groupBy("batch").applyInPandas(one, "batch long, content string, error string")
