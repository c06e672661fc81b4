"""Queries over the tables for predicates, projections, changes, checks and documents, each with its SQL."""

from __future__ import annotations

import json
import tempfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.api import Feed
from siftwell.functions import text, times
from siftwell.operators import answers, checks, cluster, dedup, presentation, reads, store, visibility
from siftwell.plans.feed import _TIMED, _ms
from siftwell.plans.registry import registry
from siftwell.session import scratch_path, table
from siftwell.sinks import documents
from siftwell.sources import feeds

QUERIES, SQL, query = registry()

ZONE = "Asia/Shanghai"
_NOW = "TIMESTAMP '2026-02-01 09:30:00'"
_AT_NOW = "cast('2026-02-01 09:30:00' as timestamp)"
#: Unicode's blanks, as the text functions take them.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_BLANK}', ' ', 'g'))"


_STATUS = "CASE WHEN success AND domain_match THEN 'verified-link' WHEN http_status = 403 THEN 'access-restricted' WHEN http_status IS NOT NULL THEN 'unverified' END"


def _status():
    return F.when(F.col("success") & F.col("domain_match"), "verified-link").when(F.col("http_status") == 403, "access-restricted").when(F.col("http_status").isNotNull(), "unverified")


@query(f"SELECT id, s AS status FROM (SELECT DISTINCT id, {_STATUS} AS s FROM source_checks) WHERE s LIKE 'verified-%' OR s = 'access-restricted'")
def checks_verified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_checks").select("id", _status().alias("status")).distinct()
    return rows.where(visibility.verified(F.col("status")))


@query(f"SELECT source_id, count(*) AS n FROM (SELECT DISTINCT id, source_id, {_STATUS} AS s FROM source_checks) WHERE s IN ('verified-primary', 'verified-publisher', 'verified-community', 'verified-link', 'access-restricted') GROUP BY source_id")
def checks_usable(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_checks").select("id", "source_id", _status().alias("status")).distinct()
    return rows.where(visibility.usable(F.col("status"))).groupBy("source_id").agg(F.count("*").alias("n"))


@query(
    f"SELECT id, kind FROM {_TIMED} WHERE (kind != 'paper' OR pub < TIMESTAMP '2025-12-01') AND (kind != 'paper' OR json_extract_string(metadata_json, '$.llm_screening.prompt_version') IN ('v5', 'v6'))"
)
def items_visible(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.timed(table(spark, d, "items"))
    version = reads.json_text("metadata_json", "$.llm_screening.prompt_version").isin("v5", "v6")
    return rows.where(visibility.only_for("paper", F.col("at") < F.lit("2025-12-01").cast("timestamp")) & visibility.only_for("paper", version)).select("id", "kind")


@query(
    f"SELECT id FROM {_TIMED} WHERE kind = 'paper' AND pub >= timezone('{ZONE}', TIMESTAMP '2025-10-14')::TIMESTAMP AND pub < timezone('{ZONE}', TIMESTAMP '2025-10-15')::TIMESTAMP AND json_extract_string(metadata_json, '$.is_new_submission') = 'true' AND json_extract_string(metadata_json, '$.published_at_verified') = 'true'"
)
def papers_of_day(spark: SparkSession, d: str) -> DataFrame:
    papers = reads.timed(table(spark, d, "items")).where("kind = 'paper'")
    return visibility.day_batch(papers, "2025-10-14", ZONE, reads.json_true("metadata_json", "$.is_new_submission"), reads.json_true("metadata_json", "$.published_at_verified")).select("id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-05' + INTERVAL 2 HOUR")
def events_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    from siftwell.streaming.ingest import within_tolerance

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts >= timestamp '2024-01-03'")
    return within_tolerance(rows, "ts", F.lit("2024-01-05").cast("timestamp")).select("event_id")


@query(
    f"SELECT i.id, f.value AS feedback_value FROM (SELECT * FROM {_TIMED} WHERE kind = 'news' AND pub >= {_NOW} - INTERVAL 480 HOUR ORDER BY pub DESC, score DESC, id DESC LIMIT 300) i "
    "LEFT JOIN (SELECT item_id, value, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, id DESC) AS r FROM feedback) f ON f.item_id = i.id AND f.r = 1"
)
def facade_recent(spark: SparkSession, d: str) -> DataFrame:
    from siftwell.sources.config import Settings

    return Feed(spark, d, Settings(news_hours=480)).items("news", "recent", limit=300, now=datetime(2026, 2, 1, 9, 30, tzinfo=UTC)).select("id", "feedback_value")


@query("SELECT id, item_id FROM feedback WHERE item_id IN (SELECT id FROM items)")
def feedback_referencing(spark: SparkSession, d: str) -> DataFrame:
    return store.referencing(table(spark, d, "feedback"), table(spark, d, "items"), "item_id").select("id", "item_id")


_LATEST = "(SELECT item_id, value FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, id DESC) AS r FROM feedback WHERE item_id IN (SELECT id FROM items)) WHERE r = 1)"


def _latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    rows = store.referencing(table(spark, d, "feedback"), table(spark, d, "items"), "item_id")
    return reads.latest(rows, "item_id", ("created_at", "id"), ("value",)).toDF("id", "value")


@query(f"SELECT id, NULL::VARCHAR AS value FROM items WHERE id NOT IN (SELECT item_id FROM {_LATEST}) UNION ALL SELECT * FROM {_LATEST}")
def rows_replaced(spark: SparkSession, d: str) -> DataFrame:
    return store.replace_keyed(table(spark, d, "items").select("id", F.lit(None).cast("string").alias("value")), _latest_feedback(spark, d), "id")


@query(f"SELECT i.id, coalesce(f.value, i.category) AS category FROM items i LEFT JOIN {_LATEST} f ON f.item_id = i.id")
def rows_updated(spark: SparkSession, d: str) -> DataFrame:
    return store.update_by_id(table(spark, d, "items").select("id", "category"), _latest_feedback(spark, d).withColumnRenamed("value", "category"), "category")


@query("SELECT id FROM items WHERE NOT coalesce(is_important, false)")
def rows_deleted(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_where(table(spark, d, "items"), F.col("is_important")).select("id")


@query("SELECT id, coalesce(source_tier, 9) AS source_tier, 'raw' AS stage FROM items")
def columns_added(spark: SparkSession, d: str) -> DataFrame:
    return store.with_columns(table(spark, d, "items").select("id", "source_tier"), {"source_tier": ("int", 9), "stage": ("string", "raw")})


def _has(term: str) -> str:
    body = "lower(coalesce(title, '') || ' ' || coalesce(summary, ''))"
    return f"regexp_matches({body}, '(^|[^a-z0-9]){term}($|[^a-z0-9])')" if len(term) <= 5 and term.isalnum() else f"contains({body}, '{term}')"


_TERMS = [("ai", "ai"), ("robot", "robots"), ("robotics", "robots"), ("open-source", "open"), ("chip", "hardware"), ("benchmark", "tests")]


@query(
    "SELECT id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {' OR '.join(_has(t) for t, x in _TERMS if x == label)} THEN '{label}' END" for label in dict.fromkeys(x for _, x in _TERMS))
    + "], lambda x: x IS NOT NULL), '|') AS labels, "
    + " + ".join(f"CASE WHEN {_has(t)} THEN {k}.5 ELSE 0 END" for k, (t, _) in enumerate(_TERMS))
    + " + 0::DOUBLE AS weight FROM items"
)
def terms_found(spark: SparkSession, d: str) -> DataFrame:
    body = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    return table(spark, d, "items").select("id", F.array_join(text.matched_terms(body, _TERMS), "|").alias("labels"), text.term_weight(body, [(t, k + 0.5) for k, (t, _) in enumerate(_TERMS)]).alias("weight"))


@query(f"SELECT id, left({_squeezed('coalesce(summary, chr(32))')}, 80) AS clipped FROM items")
def texts_clipped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", text.clipped(F.col("summary"), 80).alias("clipped"))


@query("SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '|') AS names FROM (SELECT id, list_filter(list_transform(authors, lambda x: left(trim(x), 8)), lambda x: x != '') AS l FROM items WHERE authors IS NOT NULL)")
def lists_clipped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where("authors is not null").select("id", F.array_join(text.clipped_list(F.col("authors"), 3, 8), "|").alias("names"))


@query(f"SELECT id, {_squeezed('left(title, 6)')} != '' AND contains(lower({_squeezed('summary')}), lower({_squeezed('left(title, 6)')})) AS there FROM items WHERE title IS NOT NULL AND summary IS NOT NULL")
def excerpts_contained(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").where("title is not null and summary is not null")
    return rows.select("id", text.contains_all(F.col("summary"), F.array(F.left("title", F.lit(6)))).alias("there"))


@query("""SELECT id, sha256('{"id":' || id || ',"kind":"' || kind || '"' || CASE WHEN source_tier IS NULL THEN '' ELSE ',"tier":' || source_tier END || '}') AS content FROM items WHERE kind IS NOT NULL""")
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where("kind is not null").select("id", text.content_key(kind=F.col("kind"), id=F.col("id"), tier=F.col("source_tier")).alias("content"))


_SETS = "list_distinct(list_filter(coalesce(tags, []), lambda x: x IS NOT NULL))", "list_distinct(list_filter(string_split(coalesce(category, ''), '-'), lambda x: x IS NOT NULL))"


@query(f"SELECT id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0), 9) AS likeness FROM (SELECT id, {_SETS[0]} AS a, {_SETS[1]} AS b FROM items)")
def label_likeness(spark: SparkSession, d: str) -> DataFrame:
    tags, parts = F.coalesce("tags", F.array().cast("array<string>")), F.split(F.coalesce("category", F.lit("")), "-")
    return table(spark, d, "items").select("id", F.round(text.jaccard(tags, parts), 9).alias("likeness"))


@query(f"SELECT id, CASE WHEN age <= 24 THEN 1.0::DOUBLE WHEN age <= 720 THEN 0.6 ELSE 0.2 END AS freshness FROM (SELECT id, epoch({_NOW} - fetched_at::TIMESTAMP) / 3600 AS age FROM items)")
def ages_stepped(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_micros(F.expr(_AT_NOW)) - F.unix_micros("fetched_at")) / 3.6e9
    return table(spark, d, "items").select("id", times.step_by_age(age, [(24, 1.0), (720, 0.6)], 0.2).alias("freshness"))


_LOCAL = f"timezone('{ZONE}', fetched_at)"


@query(f"SELECT id, m AS minute, CASE WHEN m >= 420 AND m < 480 THEN 'news' WHEN m >= 480 AND m < 630 THEN 'publish' ELSE 'none' END AS phase, strftime({_LOCAL}, '%Y-%m-%d %H:%M') AS shown FROM (SELECT id, fetched_at, CAST(hour({_LOCAL}) * 60 + minute({_LOCAL}) AS INTEGER) AS m FROM items)")
def local_phases(spark: SparkSession, d: str) -> DataFrame:
    minute = times.local_minute(F.col("fetched_at"), ZONE)
    return table(spark, d, "items").select("id", minute.alias("minute"), times.phase(minute, [("news", 420, 480), ("publish", 480, 630)]).alias("phase"), times.shown_local(F.col("fetched_at"), ZONE, F.lit("")).alias("shown"))


@query("SELECT id, source_id, elapsed_ms FROM (SELECT *, lag(elapsed_ms) OVER (PARTITION BY source_id ORDER BY id) AS b FROM (SELECT DISTINCT * FROM source_checks)) WHERE elapsed_ms >= b")
def checks_not_descending(spark: SparkSession, d: str) -> DataFrame:
    return checks.descending(table(spark, d, "source_checks").distinct(), "source_id", "id", "elapsed_ms").select("id", "source_id", "elapsed_ms")


@query(
    "SELECT source_id, CASE WHEN bool_or(day = '2025-10-14') THEN 'present' WHEN min(day) < '2025-10-14' AND max(day) > '2025-10-14' THEN 'empty' ELSE 'unknown' END AS state "
    f"FROM (SELECT source_id, strftime({_LOCAL}, '%Y-%m-%d') AS day FROM items) GROUP BY source_id"
)
def days_bracketed(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "items").select("source_id", times.local_date(F.col("fetched_at"), ZONE).cast("string").alias("day"))
    return checks.bracketed(days, "source_id", "day", "2025-10-14")


@query("SELECT run_id, CAST(totals AS BIGINT) AS totals, declared, came, declared = came AND totals = 1 AS complete FROM (SELECT run_id, count(DISTINCT n) AS totals, max(n)::BIGINT AS declared, count(*) AS came FROM (SELECT c.run_id, r.sources_ok + r.sources_failed AS n FROM (SELECT DISTINCT * FROM source_checks) c JOIN runs r ON r.id = c.run_id) GROUP BY run_id)")
def totals_declared(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs").select(F.col("id").alias("run_id"), (F.col("sources_ok") + F.col("sources_failed")).alias("n"))
    pages = table(spark, d, "source_checks").distinct().join(runs, "run_id").select("run_id", "n", F.lit(1).alias("one"))
    return checks.declared_totals(pages, "run_id", "n", "one")


_SIGNALS = "(SELECT i.id, i.source_id, s.j, s.pos FROM items i, (SELECT id, unnest(CAST(json_extract(metadata_json, '$.community_signals[*]') AS JSON[])) AS j, generate_subscripts(CAST(json_extract(metadata_json, '$.community_signals[*]') AS JSON[]), 1) - 1 AS pos FROM items) s WHERE s.id = i.id)"


@query(f"SELECT key, platform, id, points FROM (SELECT source_id AS key, json_extract_string(j, '$.platform') AS platform, id, CAST(json_extract_string(j, '$.points') AS INTEGER) AS points, row_number() OVER (PARTITION BY source_id, json_extract_string(j, '$.platform') ORDER BY id, pos) AS r FROM {_SIGNALS}) WHERE r = 1")
def signals_merged(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items")
    rows = reads.signals(items).join(items.select("id", F.col("source_id").alias("key")), "id")
    found = dedup.merged_signals(rows.select("key", "id", "pos", "platform", F.col("discussion_url").alias("discussion"), "period", "points"))
    return found.select("key", "platform", "id", "points")


@query(
    f"SELECT id, string_agg(line, chr(10) ORDER BY pos) AS lines FROM (SELECT id, pos, concat_ws(' / ', json_extract_string(j, '$.platform'), CASE WHEN CAST(json_extract_string(j, '$.rank') AS INTEGER) > 0 THEN '#' || json_extract_string(j, '$.rank') END, "
    f"CASE WHEN CAST(json_extract_string(j, '$.points') AS INTEGER) > 0 THEN json_extract_string(j, '$.points') || ' points' END, CASE WHEN CAST(json_extract_string(j, '$.comments') AS INTEGER) > 0 THEN json_extract_string(j, '$.comments') || ' comments' END) AS line FROM {_SIGNALS}) WHERE pos < 6 GROUP BY id"
)
def signal_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.signals(table(spark, d, "items")).select("id", "pos", presentation.signal_line(F.col("platform"), F.col("rank"), F.col("points"), F.col("comments")).alias("line"))
    return presentation.first_lines(rows, "id", "pos", "line").select("id", F.array_join("lines", "\n").alias("lines"))


@query("SELECT id, left(coalesce(title, ''), 30) AS title, length(coalesce(title, '')) <= 30 AS whole, array_to_string(CASE WHEN kind = 'paper' THEN coalesce(categories, [])[1:2] ELSE coalesce(tags, [])[1:2] END, '|') AS labels FROM items WHERE kind IS NOT NULL")
def judge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Records as the JSON that a service is given, read again."""
    rows = table(spark, d, "items").where("kind is not null").select("id", F.length(F.coalesce("title", F.lit(""))).alias("n"), presentation.candidate(30, 50, 2).alias("j"))
    read = rows.select("n", F.from_json("j", "id bigint, title string, categories array<string>, tags array<string>").alias("c"))
    return read.select("c.id", "c.title", (F.col("n") <= 30).alias("whole"), F.array_join(F.coalesce("c.categories", "c.tags"), "|").alias("labels"))


@query("SELECT id, left(coalesce(summary, ''), 480) AS excerpt, length(coalesce(summary, '')) > 480 AS truncated FROM items")
def triage_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", presentation.excerpt(F.col("summary")).alias("x")).select("id", "x.*")


@query("SELECT id, CASE category WHEN 'dataset-benchmark' THEN 'Data' WHEN 'product' THEN 'Products' ELSE category END AS label FROM items")
def category_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", presentation.labelled(F.col("category"), {"dataset-benchmark": "Data", "product": "Products"}).alias("label"))


@query("SELECT id, array_to_string(coalesce(authors, [])[1:4], ', ') || CASE WHEN len(coalesce(authors, [])) > 4 THEN ' et al.' ELSE '' END AS names, least(score, 100.0) AS shown_score, round(least(abs(coalesce(score, 0)) / 60.0 * 100, 100.0), 6) AS width FROM items")
def page_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", presentation.first_names(F.col("authors")).alias("names"), F.least("score", F.lit(100.0)).alias("shown_score"), F.round(presentation.bar_width(F.col("score"), F.lit(60.0)), 6).alias("width"))


@query("SELECT id, coalesce(canonical_url IN (SELECT canonical_url FROM incoming_items WHERE canonical_url IS NOT NULL), false) AS again FROM items")
def items_flagged(spark: SparkSession, d: str) -> DataFrame:
    return presentation.flagged(table(spark, d, "items").select("id", "canonical_url"), table(spark, d, "incoming_items"), "canonical_url", "again").select("id", "again")


_KEYS = "(SELECT id, source_id, tags, lower(trim(cluster_key)) AS k FROM items WHERE trim(coalesce(cluster_key, '')) != '')"


@query(
    f"WITH c AS (SELECT *, min(id) OVER (PARTITION BY k) AS rep FROM {_KEYS}), t AS (SELECT rep, tag, min((id != rep, id, pos)) AS o FROM (SELECT rep, id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM c) WHERE trim(tag) != '' GROUP BY rep, tag), "
    "l AS (SELECT rep, string_agg(tag, '|' ORDER BY o) AS tags FROM t GROUP BY rep) SELECT c.rep AS representative, count(*) AS size, count(DISTINCT source_id) AS sources, string_agg(CASE WHEN id != c.rep THEN id END, '|' ORDER BY id) AS alternates, coalesce(any_value(l.tags), '') AS tags "
    "FROM c LEFT JOIN l ON l.rep = c.rep GROUP BY c.rep HAVING count(*) > 1"
)
def clusters_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").where("trim(coalesce(cluster_key, '')) != ''").select("id", "source_id", "tags", F.lower(F.trim("cluster_key")).alias("k"))
    heads = rows.groupBy("k").agg(F.min("id").alias("representative"))
    found = cluster.merged(rows.join(heads, "k").select("id", "representative"), rows)
    return found.select("representative", "size", "sources", F.array_join("alternates", "|").alias("alternates"), F.array_join("tags", "|").alias("tags"))


_GOOD = f"(SELECT DISTINCT source_id FROM (SELECT source_id, {_STATUS} AS s, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS r FROM (SELECT DISTINCT * FROM source_checks)) WHERE r = 1 AND s IN ('verified-link', 'access-restricted'))"


@query(f"WITH c AS (SELECT id AS member, source_id, min(id) OVER (PARTITION BY k) AS id FROM {_KEYS}), g AS (SELECT * FROM c WHERE source_id IN (SELECT source_id FROM {_GOOD})) SELECT id, member FROM g WHERE id IN (SELECT id FROM g WHERE id = member)")
def clusters_verified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").where("trim(coalesce(cluster_key, '')) != ''").select("id", "source_id", F.lower(F.trim("cluster_key")).alias("k"))
    heads = rows.groupBy("k").agg(F.min("id").alias("head"))
    groups = rows.join(heads, "k").select(F.col("head").alias("id"), F.col("id").alias("member"), F.col("source_id").alias("url"), "source_id")
    last = reads.latest(table(spark, d, "source_checks").distinct(), "source_id", ("id",), ("success", "domain_match", "http_status"))
    return visibility.keep_usable(groups, last.select(F.col("source_id").alias("url"), "source_id", _status().alias("status")))


@query(
    f"WITH r AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY coalesce(strftime({_LOCAL}, '%Y-%m-%d') = '2026-02-01', false) DESC, score DESC, id) AS r FROM items) SELECT id, kind, r <= CASE WHEN kind = 'paper' THEN 20 ELSE 15 END AS chosen FROM r"
)
def rank_today_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best of each kind, those of the local day first, each kind with its own number."""
    rows = table(spark, d, "items").select("id", "kind", "score", visibility.fresh(F.col("fetched_at"), F.expr(_AT_NOW), ZONE).alias("today"))
    parts = [reads.flag_top(rows.where(F.coalesce((F.col("kind") == "paper"), F.lit(False)) == paper), "kind", "today desc, score desc, id", most) for paper, most in ((True, 20), (False, 15))]
    return parts[0].unionByName(parts[1]).select("id", "kind", "chosen")


@query(
    f"SELECT count(*) AS checked, coalesce(sum(CASE WHEN s LIKE 'verified%' THEN 1 ELSE 0 END), 0)::BIGINT AS verified, coalesce(sum(CASE WHEN s = 'access-restricted' THEN 1 ELSE 0 END), 0)::BIGINT AS restricted, coalesce(sum(CASE WHEN s = 'unverified' THEN 1 ELSE 0 END), 0)::BIGINT AS unverified, "
    f"coalesce(sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS unknown FROM (SELECT DISTINCT id, {_STATUS} AS s FROM source_checks)"
)
def checks_audited(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_checks").select("id", _status().alias("status")).distinct()
    return visibility.audited(rows, F.col("status"))


@query(f"SELECT i.id, coalesce(c.s, 'unknown') AS status FROM items i LEFT JOIN (SELECT source_id, {_STATUS} AS s FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS r FROM (SELECT DISTINCT * FROM source_checks)) WHERE r = 1) c ON c.source_id = i.source_id")
def items_reaudited(spark: SparkSession, d: str) -> DataFrame:
    last = reads.latest(table(spark, d, "source_checks").distinct(), "source_id", ("id",), ("success", "domain_match", "http_status"))
    rows = table(spark, d, "items").select("id", "source_id", F.lit("unknown").alias("status"))
    return visibility.reaudited(rows, last.select("source_id", _status().alias("status")), ["source_id"]).select("id", "status")


@query("SELECT count(*) AS shown, sum(CASE WHEN is_important THEN 1 ELSE 0 END)::BIGINT AS important, sum(CASE WHEN kind = 'paper' THEN 1 ELSE 0 END)::BIGINT AS papers FROM items WHERE kind = 'news' AND is_important OR kind = 'paper'")
def site_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items")
    both = reads.scan(rows, "news", important=True).unionByName(reads.scan(rows, "paper"))
    return reads.stats(both).select(F.col("total").alias("shown"), "important", "papers")


@query("SELECT coalesce(sum(greatest(1, sources_failed)), 0)::BIGINT + 2 AS attempts FROM runs WHERE sources_failed > 0 AND kind = 'news'")
def attempts_failed(spark: SparkSession, d: str) -> DataFrame:
    return visibility.attempts_used(table(spark, d, "runs").where("sources_failed > 0 and kind = 'news'"), F.col("sources_failed"), 3)


@query("SELECT coalesce((SELECT CASE WHEN sources_failed > 0 THEN 'partial' ELSE 'complete' END FROM runs WHERE json_extract_string(details, '$.digest_date') = '2025-01-18' AND json_extract_string(details, '$.prompt_version') = 'v3' ORDER BY started_at DESC, id DESC LIMIT 1), 'unavailable') AS status")
def batch_of_day(spark: SparkSession, d: str) -> DataFrame:
    return visibility.batch_status(table(spark, d, "runs"), "2025-01-18", {"prompt_version": "v3"})


@query(f"SELECT epoch_ms(coalesce((SELECT max(started_at)::TIMESTAMP FROM runs WHERE kind = 'paper' AND started_at::TIMESTAMP <= {_NOW}), {_NOW})) AS at_ms")
def snapshot_reference(spark: SparkSession, d: str) -> DataFrame:
    return visibility.snapshot_instant(table(spark, d, "runs"), "paper", F.expr(_AT_NOW)).select(_ms("at").alias("at_ms"))


@query("SELECT id, CASE WHEN sources_failed > 0 AND sources_ok = 0 THEN 'No source answered' WHEN sources_failed > 0 THEN 'Some sources failed' ELSE 'Everything came' END AS message FROM runs")
def run_messages(spark: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("sources_failed") > 0) & (F.col("sources_ok") == 0), "none").when(F.col("sources_failed") > 0, "partial").otherwise("complete")
    return table(spark, d, "runs").select("id", visibility.message(status, {"none": "No source answered", "partial": "Some sources failed"}, "Everything came").alias("message"))


@query("SELECT id FROM items WHERE kind = 'paper' AND (SELECT count(DISTINCT id) FROM items WHERE kind = 'paper') = (SELECT count(DISTINCT id) FROM items WHERE kind = 'paper' AND external_id IS NOT NULL) AND external_id IS NOT NULL")
def batch_all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "items").where("kind = 'paper'").select("id", "external_id")
    return visibility.all_or_nothing(papers.where("external_id is not null"), papers).select("id")


@query("SELECT id, abs(hash_) AS known FROM (SELECT i.id, CASE WHEN c.fingerprint IS NULL THEN 0 ELSE 1 END AS hash_ FROM items i LEFT JOIN (SELECT DISTINCT fingerprint FROM incoming_items WHERE fingerprint IS NOT NULL) c USING (fingerprint))")
def decisions_cached(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").select("id", F.col("fingerprint").alias("cache_key"))
    cache = table(spark, d, "incoming_items").select(F.col("fingerprint").alias("cache_key"), F.lit("yes").alias("decision"), F.col("received_at").alias("created_at"))
    known, new = answers.known_and_new(rows, cache)
    return known.select("id", F.lit(1).alias("known")).unionByName(new.select("id", F.lit(0).alias("known")))


@query("SELECT batch, count(*) AS rows, min(id) AS first, max(id) AS last FROM (SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 80 AS BIGINT) AS batch FROM items) GROUP BY batch")
def batches_bounded(spark: SparkSession, d: str) -> DataFrame:
    return answers.batches(table(spark, d, "items").select("id"), 80).groupBy("batch").agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"))


_BEST = "(SELECT id, kind, title, url, score FROM items WHERE kind = '{}' ORDER BY score DESC, id DESC LIMIT 20)"


@query(f"SELECT id, kind, title FROM {_BEST.format('news')} UNION ALL SELECT id, kind, title FROM {_BEST.format('paper')}")
def digest_json(spark: SparkSession, d: str) -> DataFrame:
    """The best of each kind as one JSON document, read again."""
    items = table(spark, d, "items").select("id", "kind", "title", "url", "score")
    best = [i for k in ("news", "paper") for i in documents.bounded(reads.top(items.where(F.col("kind") == k), 20, [F.desc("score"), F.desc("id")]))]
    doc = documents.json_document(best, datetime(2026, 2, 1, tzinfo=UTC))
    return spark.createDataFrame([(doc,)], "doc string").select(F.explode(F.from_json("doc", "items array<struct<id:bigint,kind:string,title:string>>")["items"]).alias("x")).select("x.*")


@query(f"SELECT title, url AS link, row_number() OVER (ORDER BY score DESC, id DESC) AS place FROM {_BEST.format('news')} WHERE trim(coalesce(title, '')) != ''")
def digest_rss(spark: SparkSession, d: str) -> DataFrame:
    """The best news as a feed, read again by the feed reader."""
    items = table(spark, d, "items").where("kind = 'news'").select("id", "title", "url", "score")
    best = documents.bounded(reads.top(items, 20, [F.desc("score"), F.desc("id")]))
    body = documents.rss(best, datetime(2026, 2, 1, tzinfo=UTC), "https://localhost/").encode()
    place = {str(i["url"]): k for k, i in enumerate(best, 1)}
    found = feeds.raw_entries(spark.createDataFrame([("s", bytearray(body))], "source_id string, payload binary"))
    places = spark.createDataFrame(list(place.items()), "link string, place long")
    stored = spark.createDataFrame([(i["url"], i["title"]) for i in best], "link string, stored string")
    return found.join(places, "link").join(stored, "link").where("trim(coalesce(stored, '')) != ''").select(F.col("stored").alias("title"), "link", "place")


@query(f"SELECT row_number() OVER (ORDER BY score DESC, id DESC)::VARCHAR || '. ' || title || ' - ' || url AS line FROM (SELECT * FROM {_BEST.format('news')} ORDER BY score DESC, id DESC LIMIT 5) WHERE title IS NOT NULL AND url IS NOT NULL")
def mail_lines(spark: SparkSession, d: str) -> DataFrame:
    _, body = documents.mail(table(spark, d, "items").where("title is not null and url is not null"), "2026-02-01", {"news": 5, "paper": 0})
    return spark.createDataFrame([(line,) for line in body.splitlines() if line[:1].isdigit()], "line string")


@query("SELECT '### ' || CASE WHEN is_important THEN '* ' ELSE '' END || '[' || replace(replace(title, '[', '\\['), ']', '\\]') || '](' || url || ')' AS heading FROM (SELECT * FROM items WHERE kind = 'news' AND title IS NOT NULL AND url IS NOT NULL ORDER BY score DESC, id DESC LIMIT 20)")
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items").where("kind = 'news' and title is not null and url is not null").select("id", "kind", "title", "url", "score", "is_important")
    body = documents.markdown(documents.bounded(reads.top(items, 20, [F.desc("score"), F.desc("id")])), datetime(2026, 2, 1, tzinfo=UTC))
    return spark.createDataFrame([(line,) for line in body.split("\n") if line.startswith("### ")], "heading string")


@query(
    "WITH u AS (SELECT id, kind, canonical_url, title, epoch_ms(created_at) AS c, 0 AS n FROM items UNION ALL SELECT id, kind, canonical_url, title, epoch_ms(received_at), 1 FROM incoming_items) "
    "SELECT kind, canonical_url, first(id ORDER BY n, c, id) AS id, first(title ORDER BY n DESC, c DESC, id DESC) AS title FROM u WHERE kind IS NOT NULL AND canonical_url IS NOT NULL GROUP BY kind, canonical_url"
)
def table_merged(spark: SparkSession, d: str) -> DataFrame:
    """A bucketed table that is merged into twice, the second time without effect, as its mark tells."""
    target = store.Table(spark, scratch_path(spark, "merged"), ["kind", "canonical_url"])
    how = {"keep": ("id", "at"), "order": ("at", "id")}
    for name, at, mark in (("items", "created_at", "first"), ("incoming_items", "received_at", "second"), ("incoming_items", "received_at", "second")):
        rows = table(spark, d, name).where("kind is not null and canonical_url is not null")
        target.merge(rows.select("id", "kind", "canonical_url", "title", F.col(at).alias("at")), mark, **how)
    return target.read().select("kind", "canonical_url", "id", "title")


@query("SELECT id, source_id, success, NULL::VARCHAR AS note FROM source_checks UNION ALL SELECT id, NULL, NULL, note FROM feedback")
def table_appended(spark: SparkSession, d: str) -> DataFrame:
    target = store.Table(spark, scratch_path(spark, "appended"))
    target.append(table(spark, d, "source_checks").select("id", "source_id", "success"))
    target.append(table(spark, d, "feedback").select("id", "note"))
    return target.read().select("id", "source_id", "success", "note")


@query("SELECT 'news' AS part, least(200, count(*))::INTEGER AS n FROM items WHERE kind = 'news' AND is_important UNION ALL SELECT 'papers', least(200, count(*))::INTEGER FROM items WHERE kind = 'paper' UNION ALL SELECT 'health', 1 UNION ALL SELECT 'usage', least(200, count(DISTINCT local_date))::INTEGER FROM llm_usage UNION ALL SELECT 'stats', 1")
def site_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each part of the snapshot holds, read again from the document."""
    doc = json.loads(Feed(spark, d).snapshot(datetime(2026, 2, 1, tzinfo=UTC)))
    return spark.createDataFrame([(p["part"], len(p["rows"])) for p in doc["items"]], "part string, n int")


@query("SELECT id, tier, array_to_string(allowed_domains, '|') AS hosts FROM sources WHERE enabled")
def sources_configured(spark: SparkSession, d: str) -> DataFrame:
    """The source dimension written as configuration and loaded from it."""
    from siftwell.sources.config import load_sources

    rows = [r.asDict() for r in table(spark, d, "sources").select("id", "name", "tier", "enabled", "allowed_domains").collect()]  # configuration
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "sources.json")
        path.write_text(json.dumps(rows), "utf-8")
        return load_sources(spark, path).select("id", "tier", F.array_join("allowed_domains", "|").alias("hosts"))


@query("SELECT * FROM (VALUES (0, '2026-01-30'), (1, '2026-01-31'), (2, '2026-02-01')) t(place, day)")
def archive_days(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of an archive: each day once, in order, however often it is published."""
    with tempfile.TemporaryDirectory() as folder:
        for day in ("2026-02-01", "2026-01-30", "2026-01-31", "2026-02-01"):
            days = documents.archive("{}", day, folder)
    return spark.createDataFrame(list(enumerate(days)), "place int, day string")


@query(f"SELECT count(*) > 0 AS done FROM runs WHERE kind = 'news' AND finished_at IS NOT NULL AND sources_ok > 0 AND strftime(timezone('{ZONE}', started_at), '%Y-%m-%d') = '2025-01-28'")
def phase_done(spark: SparkSession, d: str) -> DataFrame:
    return checks.done_today(table(spark, d, "runs"), "news", "2025-01-28", ZONE)


@query("SELECT id FROM items WHERE contains(lower(array_to_string(list_filter([title, summary, category, array_to_string(tags, ' ')], lambda x: x IS NOT NULL), ' ')), 'benchmark')")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = text.search_text(F.col("title"), F.col("summary"), F.col("category"), F.array_join("tags", " "))
    return table(spark, d, "items").where(F.contains(found, F.lit("benchmark"))).select("id")


@query("SELECT kind, count(*) AS runs, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(important) AS BIGINT) AS important, CAST(sum(sources_ok) AS BIGINT) AS ok, CAST(sum(sources_failed) AS BIGINT) AS failed, CAST(sum(len(list_filter(errors, lambda e: e = 'timeout'))) AS BIGINT) AS timeouts, round(max(epoch(finished_at) - epoch(started_at)), 3) AS longest FROM runs GROUP BY kind")
def run_audit(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum(c).alias(n) for c, n in (("fetched", "fetched"), ("accepted", "accepted"), ("important", "important"), ("sources_ok", "ok"), ("sources_failed", "failed"))]
    timeouts = F.sum(F.size(F.filter("errors", lambda e: e == "timeout"))).alias("timeouts")
    longest = F.round(F.max((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6), 3).alias("longest")
    return table(spark, d, "runs").groupBy("kind").agg(F.count("*").alias("runs"), *sums, timeouts, longest)
