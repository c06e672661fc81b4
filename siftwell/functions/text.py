"""Text functions: native expressions, with an Arrow function only for the texts that need one.

NFKC and HTML entities have no built-in, so texts that hold neither a non-ASCII character nor an ampersand stay in the JVM
and only the others cross to Python.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a title's tokens leave out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"]

# What counts as a blank, and elements whose text isn't shown.
_SPACE = r"[\s\x1c-\x1f\x85\xa0]+"
_SCRIPT = r"(?is)<(script|style)[^>]*>.*?</\1>"


@F.pandas_udf(T.StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def only_where(condition: Column, function, value: Column) -> Column:
    """function(value) where the condition holds, else the value; the function gets null elsewhere."""
    return F.when(condition, function(F.when(condition, value))).otherwise(value)


def squeeze(value: Column) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", " "))


def clean_html(value: Column) -> Column:
    """Visible text of a piece of HTML: no scripts, styles or tags, entities resolved, blanks collapsed; null is ''."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), _SCRIPT, " "), "<[^>]+>", " ")
    return squeeze(only_where(F.contains(bare, F.lit("&")), unescape_html, bare))


def normalize_title(value: Column) -> Column:
    """NFKC, lower case, words, blanks and hyphens only."""
    text = clean_html(value)
    text = F.lower(only_where(text.rlike(r"[^\x00-\x7f]"), nfkc, text))
    return squeeze(F.regexp_replace(text, r"(?U)[^\w\s\-]|[\p{Mn}\p{Mc}\p{Me}\p{Cf}&&[^\w]]", " "))


def stem(token: Column) -> Column:
    """Common endings cut from ASCII words."""
    n = F.length(token)
    word = token.rlike("^[a-z]+$")

    def ending(text: str, over: int, cut: int) -> tuple[Column, Column]:
        return word & (n > over) & F.endswith(token, F.lit(text)), F.left(token, n - cut)

    (c1, v1), (c2, v2), (c3, v3), (c4, v4) = ending("ing", 6, 3), ending("ed", 5, 2), ending("es", 5, 2), ending("s", 4, 1)
    return F.when(c1, v1).when(c2, v2).when(c3, v3).when(c4, v4).otherwise(token)


def title_tokens(value: Column, normal: bool = False) -> Column:
    """Stemmed ASCII words of more than one character without stop words, in order; `normal`: the value is normalised already."""
    text = value if normal else normalize_title(value)
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))
    return F.transform(kept, stem)


def fingerprint(normal: Column, tokens: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of a title's tokens, or of its normal form where it has none."""
    text = F.array_join(tokens, " ")
    return F.left(F.sha2(F.when(text == "", normal).otherwise(text), 256), F.lit(24))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, left against right (not symmetric)."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def jaccard(left: Column, right: Column) -> Column:
    """Likeness of two token arrays as sets; 0 where both are empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def title_similarity(normal_a: Column, tokens_a: Column, normal_b: Column, tokens_b: Column) -> Column:
    """0.7 of the tokens' likeness and 0.3 of the sequence ratio; the ratio alone where either has under three tokens."""
    ratio = sequence_ratio(normal_a, normal_b)
    few = F.least(F.size(F.array_distinct(tokens_a)), F.size(F.array_distinct(tokens_b))) < 3
    mixed = F.when(few, ratio).otherwise(F.lit(0.7) * jaccard(tokens_a, tokens_b) + F.lit(0.3) * ratio)
    return F.when((normal_a == "") | (normal_b == ""), 0.0).when(normal_a == normal_b, 1.0).otherwise(mixed)


def has_term(text: Column, term: str) -> Column:
    """Whether a lower-case text has a term: as a whole word if it's short (at most five letters and digits), else anywhere."""
    if len(term) <= 5 and term.isalnum():
        return text.rlike(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")
    return F.contains(text, F.lit(term))


def matched_terms(text: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    """The distinct labels of the (term, label) pairs found in a text, in the lexicon's order."""
    found = F.array(*(F.when(has_term(text, t), F.lit(label)) for t, label in lexicon))
    return F.array_distinct(F.array_compact(found))


def term_weight(text: Column, lexicon: Sequence[tuple[str, float]]) -> Column:
    """The sum of the weights of the terms found."""
    total = F.lit(0.0)
    for term, weight in lexicon:
        total = total + F.when(has_term(text, term), F.lit(float(weight))).otherwise(0.0)
    return total


def clipped(value: Column, most: int) -> Column:
    """Blanks collapsed, then at most so many characters."""
    return F.left(squeeze(F.coalesce(value, F.lit(""))), F.lit(most))


def unique_in_order(values: Column) -> Column:
    """Trimmed values that aren't empty, each once, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))


def clipped_list(values: Column, most: int, length: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: clipped(v, length)), lambda v: v != "")), 1, most)


def contains_all(text: Column, excerpts: Column) -> Column:
    """Whether each excerpt stands in the text, case and blanks apart; an empty list of excerpts doesn't."""
    folded = F.lower(squeeze(text))
    return (F.size(excerpts) > 0) & F.forall(excerpts, lambda e: F.contains(folded, F.lower(squeeze(e))) & (squeeze(e) != ""))


def content_key(**fields: Column) -> Column:
    """A key of a record's content: SHA-256 over its fields as JSON in order of their names."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def without_fence(value: Column) -> Column:
    """A text without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(value), r"(?s)^```(?:json)?\s*|\s*```$", ""))


def code_url(value: Column) -> Column:
    """The first address of a code host in a text, without a final dot; '' if none."""
    return F.regexp_replace(F.regexp_extract(value, r"https?://(?:www\.)?(?:github\.com|gitlab\.com|huggingface\.co)/[\w./\-]+", 0), r"[.]+$", "")


def paper_id(value: Column) -> Column:
    """The id of a versioned paper address, without its version."""
    return F.regexp_replace(F.regexp_extract(value, r"([^/]+)/?$", 1), r"v[0-9]+$", "")


def paper_version(value: Column) -> Column:
    """The version in a paper's address; 0 if none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(value, r"v([0-9]+)/?$", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))


def valid_address(value: Column) -> Column:
    """Whether a value is one plain mail address."""
    return F.coalesce(value.rlike(r"^[^@\s<>,;]+@[^@\s<>,;]+\.[^@\s<>,;.]+$"), F.lit(False))


def search_text(*values: Column) -> Column:
    """Lower-case text to be searched by substring; nulls left out."""
    return F.lower(F.concat_ws(" ", *values))
