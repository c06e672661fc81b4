"""Texts cut off before their end, from word trigrams counted inside texts and at ends, in SQL.

Words are Han characters, letter runs and single signs. Numbers count as one word, and capitalised words after a
text's first by their first letter: names and figures are too many to count one by one. Every trigram of the
corpus is counted where the text goes on and where it ends. The final trigram of a text tells that the text was
cut when it is frequent inside and almost never last. The share of ends is estimated in three steps, so that a
trigram seen rarely (its last word is broken off) leans on its first two words with the kind of the third, those on
the last word alone; a text's own end isn't counted for itself, equal long ends (of copies) count once, and without
evidence a text isn't cut. A mark of elision at the end (three dots, bracketed or with a "read more", an unclosed tag, a
broken entity or character) is taken off first and tells of a cut by itself.

Defined results: null, blank and empty texts aren't cut; a text of fewer than three words is padded at its start;
repeated rows count as often as they occur and give one result each; extra columns are ignored; an empty table gives
an empty result; all of a long text is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shown import folded
from siftwell.operators.joins import lookup
from siftwell.session import cut

# What follows a mark of elision.
MORE = ["more", "read more", "continue reading", "keep reading", "full story", "weiterlesen", "mehr", "lire la suite", "suite", "leer mas", "seguir leyendo", "читать далее", "далее", "阅读全文", "全文", "更多"]
#: A text is cut if less than this share of its final trigram's occurrences is last.
LAST_SHARE = 0.04
#: The occurrences that the wider estimate counts for beside a trigram's own, beside those of a pair or a word, and beside those of a
#: pair before a sign, of which there are always enough.
PRIOR, WIDER, SIGN = 30, 4, 30
#: The part of a pair's occurrences that counts for it beside a trigram's own, so that a fragment of a word that cuts leave again and
#: again, as corpora grow, still is rare beside the words that go on from there.
LEAN = 0.03
#: The share of ends at a word of which nothing is known: without evidence a text isn't cut.
UNKNOWN = 0.2

#: Characters at the end of a text in which a mark of elision is looked for, or all from an open tag on.
MARK_CHARS = 80
#: Characters at the end by which copies are known.
TAIL_CHARS = 60

_TOKENS = "concat(array('^', '^'), regexp_extract_all({0}, '\\\\p{{{{IsHan}}}}|\\\\^?\\\\p{{{{L}}}}+9?|[^\\\\s]', 0))"

#: The kind of a word: a name, another word of letters, or the sign itself.
_KIND = """CASE WHEN right(z, 1) = '9' OR (length(z) = 1 AND (ascii(z) BETWEEN 65 AND 90 OR ascii(z) BETWEEN 1040 AND 1071)) THEN 'N'
  WHEN ascii(z) BETWEEN 97 AND 122 OR ascii(z) BETWEEN 65 AND 90 OR ascii(z) BETWEEN 192 AND 8191 OR ascii(z) BETWEEN 12352 AND 65280 THEN 'w' ELSE z END"""

_COUNTS = f"""
SELECT pair, tri, one, sum(inside) AS inside, sum(ends) AS ends
FROM (
  SELECT xxhash64(x, y, {_KIND}) AS pair, xxhash64(x, y, z) AS tri, xxhash64(z) AS one, 1L AS inside, 0L AS ends
  FROM (
    SELECT n, pos, col.`0` AS x, col.`1` AS y, col.`2` AS z
    FROM (SELECT size(w) - 3 AS n, arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2)) AS grams FROM {{words}} WHERE size(w) > 3)
    LATERAL VIEW OUTER posexplode(grams) AS pos, col
  ) WHERE pos < n
  UNION ALL
  SELECT pair, tri, one, 0L, 1L FROM (SELECT DISTINCT pair, tri, one, tail FROM {{final}})
)
GROUP BY pair, tri, one
"""

_FINAL = f"""
SELECT id, source_id, marked, tail, xxhash64(x, y, {_KIND}) AS pair, xxhash64(x, y, z) AS tri, xxhash64(z) AS one, IF({_KIND} = z, {{sign}}, {{wider}}) AS weight
FROM (SELECT id, source_id, marked, tail, w[size(w) - 3] AS x, w[size(w) - 2] AS y, w[size(w) - 1] AS z FROM {{tails}} WHERE size(w) > 2)
"""

_JUDGED = """
WITH finals AS (SELECT pair, tri, one, weight, share FROM {finals}),
pairs AS (SELECT pair, sum(inside) AS inside, sum(ends) AS ends FROM {counts} GROUP BY pair),
shares AS (
  SELECT f.pair, f.tri, f.one,
         (t.ends - 1 + ({prior} + {lean} * (p.inside + p.ends)) * (p.ends - 1 + f.weight * f.share) / (p.inside + p.ends - 1 + f.weight))
         / (t.inside + t.ends - 1 + {prior} + {lean} * (p.inside + p.ends)) AS share
  FROM finals f
  JOIN {counts} t ON f.tri = t.tri AND f.pair = t.pair AND f.one = t.one
  JOIN pairs p ON f.pair = p.pair
)
SELECT f.id, f.source_id, f.marked, coalesce(s.share < {share}, false) AS told, f.marked OR coalesce(s.share < {share}, false) AS cut, s.share
FROM {final} f LEFT JOIN shares s ON f.pair = s.pair AND f.tri = s.tri AND f.one = s.one
"""


_WORDS = """
SELECT one, (ends - 1 + {wider} * {unknown}) / (inside + ends - 1 + {wider}) AS share
FROM (SELECT one, sum(inside) AS inside, sum(ends) AS ends FROM {counts} GROUP BY one) WHERE ends > 0
"""


def once(df: DataFrame, column: str) -> DataFrame:
    """The same rows; the column is computed once a row, however often later expressions name it."""
    return df.select(*(c for c in df.columns if c != column), F.explode(F.array(column)).alias(column))


def _classed(records: DataFrame, column: str) -> DataFrame:
    text = F.col(column).cast("string")
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = once(records.select("id", "source_id", F.when(text.rlike(r"[^\x09-\x0d\x20-\x7e]"), folded(text)).otherwise(plain).alias("text")), "text").where("text != ''")
    sign = r"(?i)(?:\s*(?:\[?\.{3}\]?|�)\s*\(?(?:" + "|".join(MORE) + r")?\)?\s*»?|\s*&#?[a-z0-9]{0,8}|\s*<[a-z/!][^<>]*|\s*�)+$"
    # from the last tag that is open, if that is longer
    open_tag = F.when(F.contains("text", F.lit("<")), F.length(F.substring_index("text", "<", -1)) + 1).otherwise(0)
    found = once(found.withColumn("near", F.greatest(F.lit(MARK_CHARS), open_tag)), "near")
    tail = F.right("text", F.col("near"))
    found = once(found.withColumn("bare", F.regexp_replace(tail, sign, "")), "bare").withColumn("marked", F.length("bare") < F.length(tail))
    body = F.when(F.col("marked"), F.concat(F.left("text", F.greatest(F.lit(0), F.length("text") - F.col("near"))), F.col("bare"))).otherwise(F.col("text"))
    # copies of a text end alike; short texts are texts of their own
    found = once(found.select("id", "source_id", "marked", body.alias("body")), "body").withColumn("tail", F.when(F.length("body") > TAIL_CHARS, F.xxhash64(F.right("body", F.lit(TAIL_CHARS)))).otherwise(F.xxhash64("id")))
    numbered = F.regexp_replace(F.concat(F.lit("^"), F.col("body")), r"[0-9]+(?:[.,][0-9]+)*", "0")
    return once(found.select("id", "source_id", "marked", "tail", F.regexp_replace(numbered, r"(?<![\p{L}^])(\p{Lu})\p{L}+", "$19").alias("classed")), "classed")


def judged(records: DataFrame, column: str = "summary") -> DataFrame:
    """(id, source_id, marked, told, cut, share) of each record whose text isn't null or blank: whether a mark tells of a cut, whether the trigrams do, and either."""
    spark = records.sparkSession
    texts = _classed(records, column)
    words = once(spark.sql(f"SELECT {_TOKENS.format('classed')} AS w FROM {{texts}}", texts=texts), "w")
    # the last three words: of the last characters, unless these hold fewer than six words
    near = once(spark.sql(f"SELECT id, source_id, marked, tail, classed, {_TOKENS.format('right(classed, 160)')} AS near FROM {{texts}}", texts=texts), "near")
    tails = once(spark.sql(f"SELECT id, source_id, marked, tail, IF(size(near) >= 8, near, {_TOKENS.format('classed')}) AS w FROM {{near}}", near=near), "w")
    final = cut(spark.sql(_FINAL, tails=tails, wider=WIDER, sign=SIGN))
    counts = cut(spark.sql(_COUNTS, words=words, final=final))
    # most texts end in one sign, so the shares of last words are looked up in a way that stands it
    words = cut(spark.sql(_WORDS, counts=counts, wider=WIDER, unknown=UNKNOWN))
    finals = lookup(final.select("pair", "tri", "one", "weight").distinct(), words, "one")
    return spark.sql(_JUDGED, final=final, finals=finals, counts=counts, prior=PRIOR, lean=LEAN, share=LAST_SHARE)


def cut_records(records: DataFrame, column: str = "summary") -> DataFrame:
    """(id) of the records whose text was cut."""
    return judged(records, column).where("cut").select("id").distinct()


def cut_rates(records: DataFrame, column: str = "summary") -> DataFrame:
    """(source_id, texts, cut, marked, told, rate): how often each source's texts are cut, with a mark of it, and as the trigrams tell with the mark off."""
    rows = judged(records, column).groupBy("source_id").agg(F.count("*").alias("texts"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("cut", "marked", "told")))
    return rows.withColumn("rate", F.col("cut") / F.col("texts"))
