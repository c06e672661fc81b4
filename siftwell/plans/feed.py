"""Queries over the record and log tables, each with the SQL that it is checked with."""

from __future__ import annotations

import unicodedata
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text, times, urls
from siftwell.operators import checks, cluster, dedup, intervals, reads, store
from siftwell.plans.registry import registry
from siftwell.session import table
from siftwell.sources import feeds

QUERIES, SQL, query = registry()

_STORED = r"regexp_full_match(published_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\+00:00')"
_AT = f"CASE WHEN {_STORED} THEN CAST(substr(published_at, 1, 19) AS TIMESTAMP) END"
_TIMED = f"(SELECT *, {_AT} AS pub FROM items)"


def _ms(column: str):
    return F.floor(F.unix_micros(column) / 1000).cast("long")


@query(f"SELECT id, kind, epoch_ms(pub) AS at_ms, score FROM {_TIMED} WHERE kind = 'news' AND category = 'dataset-benchmark' AND pub >= TIMESTAMP '2025-06-01' AND pub < TIMESTAMP '2026-06-01' ORDER BY pub DESC, score DESC, id DESC LIMIT 200")
def items_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.scan(table(spark, d, "items"), "news", category="dataset-benchmark", since=datetime(2025, 6, 1, tzinfo=UTC), before=datetime(2026, 6, 1, tzinfo=UTC))
    return reads.top(rows, 200).select("id", "kind", _ms("at").alias("at_ms"), "score")


@query("SELECT id, kind FROM items WHERE contains(lower(coalesce(title, '')), 'gripper') OR contains(lower(coalesce(summary, '')), 'gripper') OR contains(lower(coalesce(array_to_string(tags, chr(10)), '')), 'gripper')")
def items_text_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where(reads.matches_text("gripper")).select("id", "kind")


@query("SELECT id, json_extract_string(metadata_json, '$.llm_screening.prompt_version') AS version FROM items WHERE json_extract_string(metadata_json, '$.llm_screening.selected') = 'true' AND json_extract_string(metadata_json, '$.llm_screening.prompt_version') = 'v5'")
def items_json_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.scan(table(spark, d, "items"), json_equals={"$.llm_screening.prompt_version": "v5"})
    return rows.where(reads.json_true("metadata_json", "$.llm_screening.selected")).select("id", reads.json_text("metadata_json", "$.llm_screening.prompt_version").alias("version"))


@query("SELECT i.id, f.value AS feedback_value FROM items i LEFT JOIN (SELECT item_id, value, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, id DESC) AS r FROM feedback) f ON f.item_id = i.id AND f.r = 1")
def items_with_feedback(spark: SparkSession, d: str) -> DataFrame:
    return reads.with_feedback(table(spark, d, "items"), table(spark, d, "feedback")).select("id", "feedback_value")


@query("SELECT count(*) AS total, CAST(coalesce(sum(CASE WHEN kind = 'news' THEN 1 ELSE 0 END), 0) AS BIGINT) AS news, CAST(coalesce(sum(CASE WHEN kind = 'paper' THEN 1 ELSE 0 END), 0) AS BIGINT) AS papers, CAST(coalesce(sum(CASE WHEN is_important THEN 1 ELSE 0 END), 0) AS BIGINT) AS important FROM items")
def items_stats(spark: SparkSession, d: str) -> DataFrame:
    return reads.stats(table(spark, d, "items"))


@query("SELECT category, count(*) AS total, CAST(sum(CASE WHEN kind = 'news' THEN 1 ELSE 0 END) AS BIGINT) AS news, CAST(sum(CASE WHEN kind = 'paper' THEN 1 ELSE 0 END) AS BIGINT) AS papers, CAST(sum(CASE WHEN is_important THEN 1 ELSE 0 END) AS BIGINT) AS important FROM items GROUP BY category")
def items_by_category(spark: SparkSession, d: str) -> DataFrame:
    return reads.stats(table(spark, d, "items"), ["category"])


@query("SELECT DISTINCT category FROM items WHERE category IS NOT NULL ORDER BY category")
def item_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where("category is not null").select("category").distinct().orderBy("category")


_USAGE = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in reads.COUNTERS)


@query(
    "SELECT local_date, CAST(sum(call_count) AS BIGINT) AS calls, CAST(coalesce(sum(CASE WHEN status = 'success' THEN call_count END), 0) AS BIGINT) AS successful_calls, "
    f"CAST(coalesce(sum(CASE WHEN status = 'failed' THEN call_count END), 0) AS BIGINT) AS failed_calls, {_USAGE}, round(coalesce(sum(estimated_cost_usd), 0), 6) AS cost FROM llm_usage GROUP BY local_date"
)
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return reads.usage_summary(table(spark, d, "llm_usage"))


_STAGES = [("paper_triage", "triage"), ("paper_screening", "papers"), ("news_screening", "news")]


@query(
    "SELECT local_date, CASE WHEN starts_with(purpose, 'paper_triage') THEN 'triage' WHEN starts_with(purpose, 'paper_screening') THEN 'papers' WHEN starts_with(purpose, 'news_screening') THEN 'news' ELSE 'other' END AS stage, "
    "CAST(sum(call_count) AS BIGINT) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(estimated_cost_usd), 6) AS cost FROM llm_usage GROUP BY ALL ORDER BY local_date, stage"
)
def usage_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_usage").withColumn("stage", reads.stage(F.col("purpose"), _STAGES, "other"))
    sums = rows.groupBy("local_date", "stage").agg(F.sum("call_count").alias("calls"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("estimated_cost_usd"), 6).alias("cost"))
    return sums.orderBy("local_date", "stage")


@query("SELECT id, local_date, total_tokens, status FROM llm_usage ORDER BY id DESC LIMIT 200")
def usage_recent(spark: SparkSession, d: str) -> DataFrame:
    return reads.top(table(spark, d, "llm_usage").select("id", "local_date", "total_tokens", "status"), 200, [F.desc("id")])


@query(
    "SELECT id, local_date, CAST(coalesce(sum(total_tokens) OVER w, 0) AS BIGINT) AS total_tokens_before, CAST(coalesce(sum(call_count) OVER w, 0) AS BIGINT) AS call_count_before "
    "FROM llm_usage WINDOW w AS (PARTITION BY local_date ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def usage_running(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_usage").select("id", "local_date", "total_tokens", "call_count")
    return reads.running_before(rows, "local_date", "id", ["total_tokens", "call_count"]).select("id", "local_date", "total_tokens_before", "call_count_before")


@query(
    "WITH s AS (SELECT local_date, CAST(sum(total_tokens) AS BIGINT) AS t, CAST(sum(call_count) AS BIGINT) AS c, CAST(coalesce(sum(CASE WHEN status = 'success' AND provider = 'hillside' THEN total_tokens END), 0) AS BIGINT) AS lt, "
    "CAST(coalesce(sum(CASE WHEN status = 'success' AND provider = 'hillside' THEN call_count END), 0) AS BIGINT) AS lc FROM llm_usage GROUP BY local_date) "
    "SELECT local_date, CAST(greatest(0, t - lt) AS BIGINT) AS total_tokens, CAST(greatest(0, c - lc) AS BIGINT) AS call_count FROM s WHERE t > lt OR c > lc"
)
def usage_carried_forward(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum("total_tokens").alias("total_tokens"), F.sum("call_count").alias("call_count")]
    usage = table(spark, d, "llm_usage")
    local = usage.where("status = 'success' and provider = 'hillside'").groupBy("local_date").agg(*sums)
    return reads.carried_forward(local, usage.groupBy("local_date").agg(*sums), "local_date", ["total_tokens", "call_count"])


@query(
    "SELECT source_id, id, success, CAST(http_status AS INTEGER) AS http_status, item_count FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS r FROM (SELECT DISTINCT * FROM source_checks ORDER BY id DESC LIMIT 500)) WHERE r = 1"
)
def source_checks_latest(spark: SparkSession, d: str) -> DataFrame:
    return reads.newest_checks(table(spark, d, "source_checks")).select("source_id", "id", "success", F.col("http_status").cast("int").alias("http_status"), "item_count")


@query(
    "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS r FROM source_checks) WHERE r = 1), n AS (SELECT max(checked_at) AS now FROM source_checks) "
    "SELECT CAST(coalesce(sum(CASE WHEN success AND domain_match AND now - checked_at <= INTERVAL 36 HOUR THEN 1 ELSE 0 END), 0) AS BIGINT) AS healthy, "
    "CAST(coalesce(sum(CASE WHEN now - checked_at > INTERVAL 36 HOUR THEN 1 ELSE 0 END), 0) AS BIGINT) AS stale, count(*) AS sources FROM l, n"
)
def source_health(spark: SparkSession, d: str) -> DataFrame:
    all_ = table(spark, d, "source_checks")
    now = all_.agg(F.max("checked_at")).first()[0]
    return reads.health(reads.latest(all_, "source_id", ("id",), ("checked_at", "success", "domain_match")), F.lit(now))


@query(
    "SELECT source_id, count(*) AS checks, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(item_count) AS BIGINT) AS items, round(quantile_cont(elapsed_ms, 0.5), 3) AS p50, round(quantile_cont(elapsed_ms, 0.95), 3) AS p95 "
    "FROM (SELECT DISTINCT * FROM source_checks) GROUP BY source_id"
)
def source_checks_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_checks").distinct()
    return rows.groupBy("source_id").agg(
        F.count("*").alias("checks"), F.sum(F.col("success").cast("long")).alias("ok"), F.sum("item_count").alias("items"), *(F.round(F.percentile("elapsed_ms", F.lit(p)), 3).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95")))
    )


@query("SELECT id FROM runs WHERE kind = 'paper' AND sources_ok > 0 AND json_extract_string(details, '$.prompt_version') = 'v3' ORDER BY started_at DESC, id DESC LIMIT 1")
def run_latest(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest_run(table(spark, d, "runs"), "paper", details={"prompt_version": "v3"}).select("id")


@query("SELECT kind, count(*) AS runs, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(important) AS BIGINT) AS important, CAST(sum(len(errors)) AS BIGINT) AS errors, CAST(sum(CASE WHEN finished_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unfinished FROM runs GROUP BY kind")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("fetched", "accepted", "important")]
    return table(spark, d, "runs").groupBy("kind").agg(F.count("*").alias("runs"), *sums, F.sum(F.size("errors")).alias("errors"), F.sum(F.col("finished_at").isNull().cast("long")).alias("unfinished"))


@query("SELECT id, error, pos FROM (SELECT id, unnest(errors) AS error, generate_subscripts(errors, 1) - 1 AS pos FROM runs)")
def run_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").select("id", F.posexplode("errors").alias("pos", "error")).select("id", "error", F.col("pos").cast("long").alias("pos"))


@query(
    "SELECT r.id, r.sources_ok + r.sources_failed AS declared, count(DISTINCT c.id) AS came FROM runs r LEFT JOIN source_checks c ON c.run_id = r.id GROUP BY r.id, r.sources_ok, r.sources_failed HAVING count(DISTINCT c.id) != r.sources_ok + r.sources_failed"
)
def runs_incomplete(spark: SparkSession, d: str) -> DataFrame:
    came = table(spark, d, "source_checks").select("run_id", "id").distinct().groupBy("run_id").agg(F.count("*").alias("came"))
    rows = table(spark, d, "runs").select("id", (F.col("sources_ok") + F.col("sources_failed")).alias("declared"))
    return rows.join(came, rows["id"] == came["run_id"], "left").select("id", "declared", F.coalesce("came", F.lit(0)).alias("came")).where("came != declared")


@query("SELECT id, count(*) AS n FROM source_checks GROUP BY id HAVING count(*) > 1")
def checks_delivered_twice(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeated_keys(table(spark, d, "source_checks"), ["id"])


@query("SELECT source_id, 'left' AS side FROM (SELECT source_id FROM items EXCEPT SELECT id FROM sources) UNION ALL SELECT id, 'right' FROM (SELECT id FROM sources EXCEPT SELECT source_id FROM items)")
def sources_without_items(spark: SparkSession, d: str) -> DataFrame:
    return checks.key_sets_differ(table(spark, d, "items").select("source_id"), table(spark, d, "sources").select(F.col("id").alias("source_id")), "source_id")


_RANK = "coalesce(source_tier, 2147483647), -coalesce(length(summary), 0), pub IS NULL, pub, id"
_KEYED = f"(SELECT *, CASE WHEN coalesce(canonical_url, '') != '' THEN canonical_url ELSE 'title:' || fingerprint END AS key FROM {_TIMED})"


def _ranked(spark: SparkSession, d: str, key) -> DataFrame:
    rows = reads.timed(table(spark, d, "items"))
    return rows.select("id", key.alias("key"), dedup.preference(F.col("source_tier"), F.col("summary"), F.col("at"), F.col("id")).alias("rank"))


@query(f"SELECT key, winner, members FROM (SELECT key, id AS winner, count(*) OVER (PARTITION BY key) AS members, row_number() OVER (PARTITION BY key ORDER BY {_RANK}) AS r FROM {_KEYED}) WHERE r = 1")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.winners(_ranked(spark, d, dedup.dedup_key(F.col("canonical_url"), F.col("fingerprint"))))


@query(f"SELECT fingerprint AS key, winner, members FROM (SELECT fingerprint, id AS winner, count(*) OVER (PARTITION BY fingerprint) AS members, row_number() OVER (PARTITION BY fingerprint ORDER BY {_RANK}) AS r FROM {_TIMED}) WHERE r = 1")
def dedup_by_title(spark: SparkSession, d: str) -> DataFrame:
    return dedup.winners(_ranked(spark, d, F.col("fingerprint")))


@query(
    f"WITH r AS (SELECT id, fingerprint AS key, row_number() OVER (PARTITION BY fingerprint ORDER BY {_RANK}) AS r FROM {_TIMED}), w AS (SELECT key, id AS winner FROM r WHERE r = 1), "
    "b AS (SELECT w.winner, r.id AS alternate, row_number() OVER (PARTITION BY w.winner ORDER BY r.r) AS k FROM r JOIN w USING (key) WHERE r.id < w.winner) "
    "SELECT winner, alternate, 0 AS place FROM b WHERE k = 1 UNION ALL SELECT w.winner, r.id, 1 FROM r JOIN w USING (key) WHERE r.id > w.winner"
)
def dedup_alternates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.alternates(_ranked(spark, d, F.col("fingerprint")))


@query()
def story_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.timed(table(spark, d, "items")).where("kind = 'news'")
    return cluster.clusters(rows.select("id", "title", "at", F.col("source_tier").alias("tier"), F.length("summary").alias("length")))


@query("SELECT id, fingerprint FROM items")
def title_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The SQL is the stored fingerprint, which was computed from the stored title."""
    rows = table(spark, d, "items").select("id", text.normalize_title(F.col("title")).alias("n"))
    return rows.select("id", text.fingerprint(F.col("n"), text.title_tokens(F.col("n"), True)).alias("fingerprint"))


def _compatible() -> str:
    """A SQL map of the characters whose compatible form holds ASCII letters or digits, made by Unicode's rule."""
    forms = ((chr(o), unicodedata.normalize("NFKC", chr(o))) for o in range(0xA0, 0x20000))
    return "MAP {" + ", ".join(f"'{c}': '{to}'" for c, to in forms if c != to and "'" not in to and any(x.isascii() and x.isalnum() for x in to)) + "}"


_TITLE = f"lower(nfc_normalize(array_to_string(list_transform(string_split(nfc_normalize(coalesce(title, '')), ''), lambda c: coalesce(({_compatible()})[c], c)), '')))"
_ENDS = [("ing", 6, 3), ("ed", 5, 2), ("es", 5, 2), ("s", 4, 1)]
_STEM = "CASE " + " ".join(f"WHEN regexp_full_match(w, '[a-z]+') AND length(w) > {over} AND ends_with(w, '{end}') THEN left(w, length(w) - {cut_})" for end, over, cut_ in _ENDS) + " ELSE w END"


@query(f"SELECT {_STEM} AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_TITLE}, '[a-z0-9]+')) AS w FROM items) WHERE length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}) GROUP BY ALL")
def title_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select(F.explode(text.title_tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)), '^www\.', '')"


@query(
    "WITH p AS (SELECT id, lower(regexp_extract(canonical_url, '^([A-Za-z]+)://', 1)) AS s, regexp_replace(regexp_replace(lower(regexp_extract(canonical_url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', ''), ':443$', '') AS h, "
    "regexp_replace('/' || regexp_extract(canonical_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS p, "
    "list_sort(list_filter(string_split(regexp_extract(canonical_url, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.+$') AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|source|spm)='))) AS q FROM items) "
    "SELECT id, s || '://' || h || CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p"
)
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", urls.canonical_url(F.col("canonical_url")).alias("canonical"))


@query(
    f"SELECT i.id, i.host, len(list_filter(s.allowed_domains, lambda x: i.host = regexp_replace(lower(x), '^www\\.', '') OR ends_with(i.host, '.' || regexp_replace(lower(x), '^www\\.', '')))) > 0 AS allowed FROM (SELECT id, source_id, {_HOST} AS host FROM items) i JOIN sources s ON s.id = i.source_id"
)
def url_domain_allowed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").select("id", "source_id", "url")
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), "allowed_domains")
    return rows.join(sources, "source_id").select("id", urls.hostname(F.col("url")).alias("host"), urls.domain_allowed(F.col("url"), F.col("allowed_domains")).alias("allowed"))


@query(
    "WITH u AS (SELECT id, kind, canonical_url, title, epoch_ms(created_at) AS c, 0 AS n FROM items UNION ALL SELECT id, kind, canonical_url, title, epoch_ms(received_at), 1 FROM incoming_items) "
    "SELECT kind, canonical_url, first(id ORDER BY n, c, id) AS id, first(c ORDER BY n, c, id) AS created_ms, first(title ORDER BY n DESC, c DESC, id DESC) AS title FROM u WHERE kind IS NOT NULL AND canonical_url IS NOT NULL GROUP BY kind, canonical_url "
    "UNION ALL SELECT kind, canonical_url, id, c, title FROM u WHERE kind IS NULL OR canonical_url IS NULL"
)
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "items").select("id", "kind", "canonical_url", "title", _ms("created_at").alias("created_ms"))
    changes = table(spark, d, "incoming_items").select("id", "kind", "canonical_url", "title", _ms("received_at").alias("created_ms"))
    return store.upsert(current, changes, ["kind", "canonical_url"], keep=("id", "created_ms"), order=("created_ms", "id"))


@query("SELECT DISTINCT i.id FROM items i WHERE i.id IN (SELECT item_id FROM documents) AND i.id IN (SELECT item_id FROM feedback)")
def membership_semi(spark: SparkSession, d: str) -> DataFrame:
    docs, feedback = (table(spark, d, t).where("item_id is not null").select(F.col("item_id").alias("id")) for t in ("documents", "feedback"))
    return checks.members(table(spark, d, "items").join(docs, "id", "left_semi"), feedback, "id")[0]


@query("SELECT DISTINCT id FROM items WHERE id NOT IN (SELECT item_id FROM documents WHERE item_id IS NOT NULL)")
def membership_anti(spark: SparkSession, d: str) -> DataFrame:
    return checks.members(table(spark, d, "items"), table(spark, d, "documents").select(F.col("item_id").alias("id")), "id")[1]


@query("SELECT strftime(timezone('Asia/Shanghai', fetched_at), '%Y-%m-%d') AS day, kind, count(*) AS n FROM items GROUP BY ALL")
def local_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").groupBy(times.local_date(F.col("fetched_at"), "Asia/Shanghai").cast("string").alias("day"), "kind").agg(F.count("*").alias("n"))


@query("SELECT id, epoch_ms(timezone('America/New_York', date_trunc('day', timezone('America/New_York', fetched_at)))) AS since_ms, epoch_ms(timezone('America/New_York', date_trunc('day', timezone('America/New_York', fetched_at)) + INTERVAL 1 DAY)) AS before_ms FROM items")
def local_day_bounds(spark: SparkSession, d: str) -> DataFrame:
    since, before = times.local_day(F.col("fetched_at"), "America/New_York")
    return table(spark, d, "items").select("id", since.alias("s"), before.alias("b")).select("id", _ms("s").alias("since_ms"), _ms("b").alias("before_ms"))


_CALENDAR = """WITH days AS (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2024-11-22', DATE '2026-09-30', INTERVAL 1 DAY) t(x)),
due AS (SELECT day, CASE WHEN isodow(day) = 7 THEN day - 2 ELSE day END AS due FROM days WHERE isodow(day) IN (1, 2, 3, 4, 7) AND day NOT IN (DATE '2025-12-25', DATE '2026-01-01')),
c AS (SELECT day, due, lag(due) OVER (ORDER BY day) AS earlier FROM due),
cal AS (SELECT strftime(day, '%Y-%m-%d') AS day, timezone('America/New_York', CAST(earlier AS TIMESTAMP) + INTERVAL 14 HOUR) AS since, timezone('America/New_York', CAST(due AS TIMESTAMP) + INTERVAL 14 HOUR) AS before,
timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 20 HOUR) AS announced FROM c WHERE day >= DATE '2025-01-01' AND earlier IS NOT NULL)
"""


def _calendar(spark: SparkSession) -> DataFrame:
    return times.announcement_calendar(spark, "2025-01-01", "2026-09-30", ["2025-12-25", "2026-01-01"])


@query(_CALENDAR + "SELECT day, epoch_ms(since) AS since_ms, epoch_ms(before) AS before_ms, epoch_ms(announced) AS announced_ms FROM cal")
def announcement_calendar(spark: SparkSession, d: str) -> DataFrame:
    return _calendar(spark).select(F.col("day").cast("string").alias("day"), *(_ms(c).alias(f"{c}_ms") for c in ("since", "before", "announced")))


@query(_CALENDAR + "SELECT i.id, cal.day FROM items i LEFT JOIN cal ON i.fetched_at >= cal.since AND i.fetched_at < cal.before")
def submission_interval_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").select("id", "fetched_at")
    return intervals.within(rows, F.col("fetched_at"), _calendar(spark), "since", "before", how="left").select("id", F.col("day").cast("string").alias("day"))


@query("SELECT id, kind, r <= 15 AS chosen FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS r FROM items)")
def rank_flag_topk(spark: SparkSession, d: str) -> DataFrame:
    return reads.flag_top(table(spark, d, "items").select("id", "kind", "score"), "kind", "score desc, id", 15).select("id", "kind", "chosen")


@query("SELECT id, CAST((n - 1) // 80 AS BIGINT) AS batch FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM items)")
def batch_split(spark: SparkSession, d: str) -> DataFrame:
    return reads.numbered(table(spark, d, "items").select("id"), "id").select("id", F.floor((F.col("n") - 1) / 80).cast("long").alias("batch"))


@query(f"SELECT id, kind, epoch_ms(pub) AS at_ms FROM {_TIMED} WHERE kind = 'news' AND is_important UNION ALL SELECT id, kind, epoch_ms(pub) FROM {_TIMED} WHERE kind = 'paper' ORDER BY at_ms DESC, kind, id")
def export_union(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.timed(table(spark, d, "items"))
    both = reads.scan(rows, "news", important=True).unionByName(reads.scan(rows, "paper"))
    return both.select("id", "kind", _ms("at").alias("at_ms")).orderBy(F.desc("at_ms"), "kind", "id")


@query("SELECT id, lower(array_to_string(list_filter([title, summary, category, array_to_string(tags, ' ')], lambda x: x IS NOT NULL), ' ')) AS search FROM items")
def search_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", text.search_text(F.col("title"), F.col("summary"), F.col("category"), F.array_join("tags", " ")).alias("search"))


@query(
    "WITH s AS (SELECT id, unnest(CAST(json_extract(metadata_json, '$.community_signals[*]') AS JSON[])) AS j FROM items) "
    "SELECT s.id, json_extract_string(j, '$.platform') AS platform, CAST(json_extract_string(j, '$.rank') AS INTEGER) AS rank, CAST(json_extract_string(j, '$.points') AS INTEGER) AS points, CAST(json_extract_string(j, '$.comments') AS INTEGER) AS comments FROM s"
)
def signals_unnested(spark: SparkSession, d: str) -> DataFrame:
    return reads.signals(table(spark, d, "items")).select("id", "platform", "rank", "points", "comments")


@query(
    "WITH s AS (SELECT id, unnest(CAST(json_extract(metadata_json, '$.community_signals[*]') AS JSON[])) AS j FROM items), "
    "x AS (SELECT s.id, CAST(json_extract_string(j, '$.rank') AS INTEGER) AS r, CAST(json_extract_string(j, '$.points') AS INTEGER) AS p, CAST(json_extract_string(j, '$.comments') AS INTEGER) AS c, "
    "coalesce(q.community_rank_limit, 0) AS l, coalesce(q.community_min_points, 0) AS mp, coalesce(q.community_min_comments, 0) AS mc FROM s JOIN sources q ON q.id = json_extract_string(j, '$.platform')) "
    "SELECT id, bool_or(CASE WHEN l > 0 AND r > l THEN false WHEN mp > 0 OR mc > 0 THEN (mp > 0 AND p >= mp) OR (mc > 0 AND c >= mc) ELSE l > 0 END) AS hot FROM x GROUP BY id"
)
def signals_qualified(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "sources").select(F.col("id").alias("platform"), "community_rank_limit", "community_min_points", "community_min_comments")
    rows = reads.signals(table(spark, d, "items")).join(sources, "platform")
    hot = reads.heat_qualified(F.col("rank"), F.col("points"), F.col("comments"), F.col("community_rank_limit"), F.col("community_min_points"), F.col("community_min_comments"))
    return rows.groupBy("id").agg(F.bool_or(hot).alias("hot"))


@query("SELECT d.doc_id, d.item_id, contains(lower(d.text), lower(i.title)) AS named FROM documents d JOIN items i ON i.id = d.item_id WHERE d.text IS NOT NULL AND i.title IS NOT NULL")
def documents_mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and item_id is not null")
    items = table(spark, d, "items").where("title is not null").select(F.col("id").alias("item_id"), "title")
    return docs.join(items, "item_id").select("doc_id", "item_id", F.contains(F.lower("text"), F.lower("title")).alias("named"))


@query("SELECT item_id, count(*) AS n, CAST(sum(CASE WHEN value = 'saved' THEN 1 ELSE 0 END) AS BIGINT) AS saved, CAST(sum(CASE WHEN coalesce(note, '') != '' THEN 1 ELSE 0 END) AS BIGINT) AS noted FROM (SELECT DISTINCT * FROM feedback) GROUP BY item_id ORDER BY n DESC, item_id LIMIT 100")
def feedback_top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feedback").distinct()
    sums = rows.groupBy("item_id").agg(F.count("*").alias("n"), F.sum((F.col("value") == "saved").cast("long")).alias("saved"), F.sum((F.coalesce("note", F.lit("")) != "").cast("long")).alias("noted"))
    return reads.top(sums, 100, [F.desc("n"), F.asc("item_id")])


@query("SELECT strftime(date_trunc('day', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling_local_day(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = rows.groupBy(F.window("ts", "1 day", "1 day", "16 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.date_format(F.col("window.start") + F.expr("interval 8 hours"), "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("SELECT source_id, json_extract_string(metadata_json, '$.feed_url') AS feed_url, count(*) AS n FROM items GROUP BY ALL")
def json_path_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").groupBy("source_id", reads.json_text("metadata_json", "$.feed_url").alias("feed_url")).agg(F.count("*").alias("n"))


@query("SELECT s.id AS source_id, s.type, count(i.id) AS items, CAST(coalesce(sum(CASE WHEN i.is_important THEN 1 ELSE 0 END), 0) AS BIGINT) AS important FROM sources s LEFT JOIN items i ON i.source_id = s.id GROUP BY s.id, s.type")
def items_by_source(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "items").groupBy("source_id").agg(F.count("id").alias("items"), F.sum(F.col("is_important").cast("long")).alias("important"))
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), "type")
    return sources.join(counts, "source_id", "left").select("source_id", "type", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("important", F.lit(0)).alias("important"))


@query("SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS listed FROM (SELECT id, list_filter(list_transform(list_concat(coalesce(tags, []), coalesce(categories, [])), lambda x: trim(x)), lambda x: x != '') AS l FROM items)")
def labels_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").select("id", text.unique_in_order(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("categories", F.array().cast("array<string>")))).alias("l"))
    return rows.select("id", F.array_join("l", "|").alias("listed"))


@query()
def title_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.timed(table(spark, d, "items")).where("kind = 'news'")
    return cluster.similar_pairs(cluster.titled(rows.select("id", "title", "at", F.col("source_tier").alias("tier"), F.length("summary").alias("length"))))


@query("SELECT CAST(id AS VARCHAR) AS guid, source_id, trim(url) AS link FROM items WHERE trim(coalesce(url, '')) != ''")
def feed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Each record written as a feed of one item and read again."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table(spark, d, "items").where("trim(coalesce(url, '')) != ''")
    item = F.concat(F.lit("<rss><channel><item><title>T</title><guid>"), F.col("id").cast("string"), F.lit("</guid><link>"), safe(F.col("url")), F.lit("</link></item></channel></rss>"))
    return feeds.raw_entries(rows.select("source_id", item.cast("binary").alias("payload"))).select("guid", "source_id", "link")
