"""Queries over beliefs, evidence, outcomes, sessions and curated text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone import constants as C
from loomstone.functions import text as T
from loomstone.operators import beliefs as B

from .registry import query

R6 = T.rounded


@query("calibration_curve", """SELECT round(confidence, 1) AS bucket, count(*) AS n_beliefs, CAST(sum(coalesce(confirmed, 0)) AS BIGINT) AS confirmed,
    CAST(sum(coalesce(contradicted, 0)) AS BIGINT) AS contradicted, CAST(sum(coalesce(stale, 0)) AS BIGINT) AS stale,
    round(CASE WHEN sum(total) > 0 THEN sum(confirmed) / sum(total)::DOUBLE END, 6) AS precision FROM beliefs LEFT JOIN counts ON belief_id = id GROUP BY 1""")
def calibration_curve(v):
    return B.calibration_curve(v.beliefs, v.outcomes).withColumn("precision", R6(F.col("precision")))


@query("outcome_counts", "SELECT belief_id, confirmed, contradicted, stale, total FROM counts")
def outcome_counts(v):
    return B.outcome_counts(v.outcomes)


@query("calibration_posterior", """SELECT id, round((2 * confidence + coalesce(confirmed, 0)) / (2 + coalesce(confirmed, 0) + coalesce(contradicted, 0)), 6) AS posterior
    FROM beliefs LEFT JOIN counts ON belief_id = id""")
def calibration_posterior(v):
    return B.calibrated(v.beliefs, v.outcomes).select("id", R6(F.col("posterior")).alias("posterior"))


@query("contradiction_dormant", """SELECT id, CASE WHEN status = 'active' AND coalesce(contradicted, 0) >= 2 THEN 'dormant' ELSE status END AS new_status
    FROM beliefs LEFT JOIN counts ON belief_id = id""")
def contradiction_dormant(v):
    return B.contradicted_dormant(v.beliefs, v.outcomes).select("id", "new_status")


@query("dormant_sweep", """SELECT id, subject FROM beliefs WHERE status = 'active' AND confidence < 0.95
    AND strptime(coalesce(last_referenced, updated), '%Y-%m-%dT%H:%M:%SZ') < TIMESTAMP '2024-03-01' - INTERVAL 45 DAY""")
def dormant_sweep(v):
    return B.dormant_sweep(v.beliefs, C.NOW).select("id", "subject")


@query("belief_fold_exact", """SELECT subject, translate(claim, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS claim_key, min(id) AS id, max(confidence) AS confidence,
    count(*) - 1 AS n_reinforced FROM beliefs WHERE status = 'active' GROUP BY 1, 2""")
def belief_fold_exact(v):
    return B.fold_exact(v.active)


@query("supersede_apply", """SELECT coalesce(b.superseded_by, e.belief_id) AS belief_id, count(*) AS n_evidence, count(DISTINCT e.session_id) AS n_sessions
    FROM evidence e LEFT JOIN beliefs b ON b.id = e.belief_id AND b.superseded_by <> b.id GROUP BY 1""")
def supersede_apply(v):
    return B.supersede(v.beliefs, v.evidence)


@query("missing_supersedes", "SELECT count(*) AS missing FROM beliefs b WHERE superseded_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = b.superseded_by AND e.dst = b.id)")
def missing_supersedes(v):
    want = B.survivors(v.beliefs).select(F.col("new").alias("src"), F.col("old").alias("dst"))
    return want.join(v.edges, ["src", "dst"], "left_anti").agg(F.count("*").alias("missing"))


@query("evidence_counts", "SELECT belief_id, count(*) AS n_evidence, count(DISTINCT session_id) AS n_sessions FROM evidence GROUP BY 1")
def evidence_counts(v):
    return v.evidence.groupBy("belief_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("session_id").alias("n_sessions"))


@query("consult_counts", """SELECT id, (SELECT count(*) FROM outcomes o WHERE o.belief_id = b.id AND event = 'confirmed') AS confirmed,
    (SELECT count(*) FROM outcomes o WHERE o.belief_id = b.id AND event <> 'confirmed') AS against, (SELECT count(*) FROM evidence e WHERE e.belief_id = b.id) AS n_evidence FROM beliefs b""")
def consult_counts(v):
    """Counts per belief as two pre-aggregated left joins."""
    seen = v.evidence.groupBy(F.col("belief_id").alias("id")).agg(F.count("*").alias("n_evidence"))
    rows = B.with_counts(v.beliefs, v.outcomes).join(seen, "id", "left").fillna(0, subset=["n_evidence"])
    return rows.select("id", "confirmed", (F.col("contradicted") + F.col("stale")).alias("against"), "n_evidence")


@query("consult_split", """SELECT id, CASE WHEN coalesce(total, 0) >= 3 THEN 'steer' ELSE 'cite' END AS tier,
    round((2 * confidence + coalesce(confirmed, 0)) / (2 + coalesce(total, 0)), 6) AS posterior FROM beliefs LEFT JOIN counts ON belief_id = id WHERE status = 'active'""")
def consult_split(v):
    """Three outcomes or more steer, fewer are cited; consulting counts stale as against."""
    rows = B.with_counts(v.active, v.outcomes)
    post = T.posterior(F.col("confidence"), F.col("confirmed"), F.col("contradicted") + F.col("stale"))
    return rows.select("id", F.when(F.col("total") >= C.ADMITTED_OUTCOMES, "steer").otherwise("cite").alias("tier"), R6(post).alias("posterior"))


@query("provenance_counts", """SELECT CASE WHEN via = 'approved' THEN 'approved' WHEN via IN ('derived', 'dream') THEN via ELSE coalesce(writer, 'unknown') END AS label, count(*) AS n FROM beliefs GROUP BY 1""")
def provenance_counts(v):
    return v.beliefs.groupBy(B.provenance().alias("label")).agg(F.count("*").alias("n"))


@query("status_counters", """SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'dormant') AS dormant, count(*) FILTER (status = 'superseded') AS superseded,
    count(*) FILTER (status = 'retracted') AS retracted, count(*) AS total FROM beliefs""")
def status_counters(v):
    return v.beliefs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in C.STATUSES), F.count("*").alias("total"))


@query("motd_delta", "SELECT count(*) AS new_beliefs, count(*) FILTER (status = 'active') AS new_active, max(id) AS high_water FROM beliefs WHERE id > 100")
def motd_delta(v):
    return v.beliefs.where("id > 100").agg(F.count("*").alias("new_beliefs"), F.count_if(F.col("status") == "active").alias("new_active"), F.max("id").alias("high_water"))


@query("recent_counts", "SELECT count(*) FILTER (created >= '2024-01-29T00:00:00Z') AS last_day, count(*) FILTER (created >= '2024-01-23T00:00:00Z') AS last_week, count(*) AS total FROM evidence")
def recent_counts(v):
    """Evidence of the day and the week before a fixed instant, 2024-01-30; text timestamps compare as text."""
    return v.evidence.agg(F.count_if(F.col("created") >= "2024-01-29T00:00:00Z").alias("last_day"), F.count_if(F.col("created") >= "2024-01-23T00:00:00Z").alias("last_week"), F.count("*").alias("total"))


@query("belief_list", "SELECT id, subject, confidence, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, id) AS place FROM beliefs WHERE status IN ('active', 'dormant')")
def belief_list(v):
    """Listing order within each subject."""
    w = Window.partitionBy("subject").orderBy(F.desc("confidence"), "id")
    return v.beliefs.where("status in ('active', 'dormant')").select("id", "subject", "confidence", F.row_number().over(w).cast("long").alias("place"))


@query("belief_filter", "SELECT id, subject, status FROM beliefs WHERE (contains(lower(subject), 'on') OR contains(lower(claim), 'thtion')) AND status IN ('active', 'superseded')")
def belief_filter(v):
    hit = F.lower("subject").contains("on") | F.lower("claim").contains("thtion")
    return v.beliefs.where(hit & F.col("status").isin("active", "superseded")).select("id", "subject", "status")


@query("belief_recency", "SELECT id, strftime(coalesce(try_strptime(CASE WHEN id % 7 <> 0 THEN updated ELSE 'bad' END, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(created, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%d %H:%M:%S') AS recency FROM beliefs")
def belief_recency(v):
    """First valid of updated and created; a seventh of the inputs is broken on purpose."""
    fmt = "\"yyyy-MM-dd'T'HH:mm:ss'Z'\""
    return v.beliefs.selectExpr("id", f"date_format(coalesce(cast(try_to_timestamp(case when id % 7 <> 0 then updated else 'bad' end, {fmt}) as timestamp_ntz), cast(try_to_timestamp(created, {fmt}) as timestamp_ntz)), 'yyyy-MM-dd HH:mm:ss') recency")


@query("newest_beliefs", "SELECT id, created FROM beliefs WHERE status = 'active' ORDER BY created DESC, id LIMIT 5")
def newest_beliefs(v):
    return v.active.orderBy(F.desc("created"), "id").limit(5).select("id", "created")


@query("interaction_model", "SELECT id, confidence, updated FROM beliefs WHERE subject = 'user-model' AND status = 'active' ORDER BY confidence DESC, updated DESC, id LIMIT 5")
def interaction_model(v):
    return v.active.where("subject = 'user-model'").orderBy(F.desc("confidence"), F.desc("updated"), "id").limit(5).select("id", "confidence", "updated")


@query("evidence_page", "SELECT event_id, belief_id, (SELECT count(*) FROM evidence) > 40 AS more FROM evidence ORDER BY event_id LIMIT 20 OFFSET 20")
def evidence_page(v):
    """A page by offset; one row more than the page tells whether it is the last."""
    page = v.evidence.orderBy("event_id").offset(20).limit(21).withColumn("n", F.count("*").over(Window.partitionBy()))
    return page.withColumn("more", F.col("n") > 20).orderBy("event_id").limit(20).select("event_id", "belief_id", "more")


@query("known_projects", "SELECT project FROM msg UNION SELECT project FROM evidence UNION SELECT subject FROM beliefs WHERE subject LIKE 'project:%'")
def known_projects(v):
    return v.msg.select("project").union(v.evidence.select("project")).union(v.beliefs.where("subject like 'project:%'").select("subject")).distinct()


@query("resolve_uid", "SELECT uid, id FROM beliefs UNION SELECT sha256('alias' || id), superseded_by FROM beliefs WHERE superseded_by IS NOT NULL")
def resolve_uid(v):
    alias = v.beliefs.where("superseded_by is not null").selectExpr("sha2(concat('alias', id), 256) uid", "superseded_by id")
    return v.beliefs.select("uid", "id").unionByName(alias).distinct()


@query("portable_beliefs", "SELECT b.uid, b.subject, b.status, s.uid AS survivor_uid FROM beliefs b LEFT JOIN beliefs s ON s.id = b.superseded_by")
def portable_beliefs(v):
    survivor = v.beliefs.select(F.col("id").alias("superseded_by"), F.col("uid").alias("survivor_uid"))
    return v.beliefs.join(survivor, "superseded_by", "left").select("uid", "subject", "status", "survivor_uid")


@query("refile_dups", """SELECT a.id AS moved, min(b.id) AS kept FROM beliefs a JOIN beliefs b ON lower(a.claim) = lower(b.claim) AND b.subject = 'user' WHERE a.subject = 'user-model'
    AND a.status = 'active' AND b.status = 'active' GROUP BY 1""")
def refile_dups(v):
    """Claims of one subject moved to another: verbatim duplicates there are superseded by the least id."""
    kept = v.active.where("subject = 'user'").groupBy(F.lower("claim").alias("c")).agg(F.min("id").alias("kept"))
    return v.active.where("subject = 'user-model'").withColumn("c", F.lower("claim")).join(kept, "c").select(F.col("id").alias("moved"), "kept")


@query("belief_status_fold", """SELECT id, CASE WHEN id % 13 = 0 THEN 'retracted' WHEN status = 'active' AND coalesce(contradicted, 0) >= 2 THEN 'dormant' ELSE status END AS status
    FROM beliefs LEFT JOIN counts ON belief_id = id""")
def belief_status_fold(v):
    """Retraction takes any status; contradictions only active ones."""
    rows = B.contradicted_dormant(v.beliefs, v.outcomes)
    return rows.select("id", F.when(F.col("id") % 13 == 0, "retracted").otherwise(F.col("new_status")).alias("status"))


# Sessions


@query("session_summary", "SELECT session_id, project, messages, first_ts, last_ts FROM sessions")
def session_summary(v):
    return v.sessions.select("session_id", "project", "messages", "first_ts", "last_ts")


@query("portable_sessions", "SELECT session_id, coalesce(CASE project WHEN 'p0' THEN 'host/zero' WHEN 'p1' THEN 'host/one' END, project) AS project_key FROM sessions")
def portable_sessions(v):
    """The dimension of project keys is four rows here; a broadcast join with a fallback to the slug."""
    keys = v.spark.createDataFrame([("p0", "host/zero"), ("p1", "host/one")], "project string, project_key string")
    return v.sessions.join(F.broadcast(keys), "project", "left").select("session_id", F.coalesce("project_key", "project").alias("project_key"))


@query("unreviewed_sessions", "SELECT session_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM reviewed)")
def unreviewed_sessions(v):
    return v.sessions.select("session_id").join(v.reviewed, "session_id", "left_anti")


@query("backfill_plan", """SELECT project, count(*) AS n_sessions, min(first_ts) AS oldest FROM sessions WHERE session_id NOT IN (SELECT session_id FROM reviewed)
    AND session_id IN (SELECT session_id FROM msg WHERE role = 'user' GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1""")
def backfill_plan(v):
    busy = v.msg.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("n")).where("n >= 3")
    rows = v.sessions.join(v.reviewed, "session_id", "left_anti").join(busy, "session_id", "left_semi")
    return rows.groupBy("project").agg(F.count("*").alias("n_sessions"), F.min("first_ts").alias("oldest"))


@query("sessions_recent", "SELECT session_id, project, last_ts FROM sessions ORDER BY CASE WHEN project = 'p1' THEN 0 ELSE 1 END, last_ts DESC, session_id LIMIT 20")
def sessions_recent(v):
    return v.sessions.orderBy(F.when(F.col("project") == "p1", 0).otherwise(1), F.desc("last_ts"), "session_id").limit(20).select("session_id", "project", "last_ts")


@query("sessions_prefix", "SELECT session_id, title FROM sessions WHERE starts_with(session_id, 's1')")
def sessions_prefix(v):
    return v.sessions.where(F.col("session_id").startswith("s1")).select("session_id", "title")


@query("session_meta", "SELECT session_id, messages FROM sessions WHERE session_id IN ('s3', 's1', 's7')")
def session_meta(v):
    ids = v.spark.createDataFrame([("s3",), ("s1",), ("s3",), ("s7",)], "session_id string").distinct()
    return v.sessions.join(F.broadcast(ids), "session_id", "left_semi").select("session_id", "messages")


@query("digest_lines", """SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'U: ' WHEN 'assistant' THEN 'A: ' ELSE 'T: ' END || substr(content, 1, 700), chr(10) ORDER BY rowid) AS digest
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rowid DESC) AS back FROM msg) WHERE back <= 500 GROUP BY 1""")
def digest_lines(v):
    """Last 500 messages, 700 characters each, the last 250,000 characters of the whole: limits of the digest itself."""
    w = Window.partitionBy("session_id").orderBy(F.desc("rowid"))
    tag = F.when(F.col("role") == "user", "U: ").when(F.col("role") == "assistant", "A: ").otherwise("T: ")
    rows = v.msg.withColumn("back", F.row_number().over(w)).where(F.col("back") <= C.DIGEST_MESSAGES)
    rows = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rowid", F.concat(tag, F.substring("content", 1, C.DIGEST_CHARS)).alias("l")))).alias("r"))
    return rows.select("session_id", F.expr(f"right(array_join(transform(r, x -> x.l), '\n'), {C.DIGEST_TOTAL})").alias("digest"))


@query("internal_sessions", "SELECT session_id FROM msg WHERE role = 'user' GROUP BY 1 HAVING starts_with(arg_min(content, rowid), 'The') OR starts_with(arg_min(content, rowid), 'La ')")
def internal_sessions(v):
    """Sessions whose opening user message starts with a marker."""
    first = v.msg.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "rowid").alias("c"))
    return first.where(F.col("c").startswith("The") | F.col("c").startswith("La ")).select("session_id")


@query("dedup_sources", "SELECT session_id FROM sessions WHERE session_id NOT IN (SELECT 's' || (user_id * 2) FROM events)")
def dedup_sources(v):
    side = v.table("events").selectExpr("concat('s', user_id * 2) session_id").distinct()
    return v.sessions.select("session_id").join(side, "session_id", "left_anti")


@query("like_scan", "SELECT session_id, rowid FROM msg WHERE content ILIKE '%the a%'")
def like_scan(v):
    """LIKE without case, the needle's own wildcards escaped."""
    return v.msg.where(F.col("content").ilike("%the a%")).select("session_id", "rowid")


@query("like_snippet", """SELECT session_id, rowid, substr(content, greatest(1, i - 60), i - greatest(1, i - 60)) || '[' || substr(content, i, 3) || ']' || substr(content, i + 3, 60) AS snippet
    FROM (SELECT *, instr(lower(content), 'the') AS i FROM msg) WHERE i > 0""")
def like_snippet(v):
    rows = v.msg.withColumn("i", F.instr(F.lower("content"), "the")).where("i > 0").withColumn("from", F.greatest(F.lit(1), F.col("i") - 60))
    return rows.selectExpr("session_id", "rowid", "concat(substring(content, from, i - from), '[', substring(content, i, 3), ']', substring(content, i + 3, 60)) snippet")


# Curated text


@query("memory_entries", "SELECT bucket, doc_id, pos, entry FROM entries")
def memory_entries(v):
    return v.entries


@query("memory_usage", "SELECT bucket, count(*) AS n, CAST(sum(length(entry) + 3) AS BIGINT) AS rendered, round(100.0::DOUBLE * sum(length(entry) + 3) / 9000, 0) AS percent FROM entries GROUP BY 1")
def memory_usage(v):
    rows = v.entries.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.char_length("entry") + 3).alias("rendered"))
    return rows.withColumn("percent", F.round(100.0 * F.col("rendered") / C.MEMORY_CAP, 0))


@query("memory_render_cap", """SELECT doc_id, sum(length(entry) + 3) <= 9000 AS written, CASE WHEN sum(length(entry) + 3) <= 9000 THEN string_agg('- ' || entry, chr(10) ORDER BY encode(entry)) || chr(10) ELSE '' END AS rendered
    FROM (SELECT DISTINCT doc_id, entry FROM entries) GROUP BY 1""")
def memory_render_cap(v):
    """Entries sorted by code point; nothing is written when the file would pass its cap. One file per document here."""
    size = F.sum(F.char_length("entry") + 3)
    # Only what fits is gathered: a file over the cap is counted, not collected.
    rows = v.entries.select("doc_id", "entry").distinct()
    fits = rows.groupBy("doc_id").agg(size.alias("n")).withColumn("written", F.col("n") <= C.MEMORY_CAP)
    text = rows.join(fits.where("written"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list("entry")).alias("e"))
    text = text.select("doc_id", F.expr("concat(array_join(transform(e, x -> concat('- ', x)), '\n'), '\n')").alias("rendered"))
    return fits.join(text, "doc_id", "left").select("doc_id", "written", F.coalesce("rendered", F.lit("")).alias("rendered"))


@query("filemap_rows", "SELECT doc_id, pos, split_part(entry, ' | ', 1) AS path, substr(entry, length(split_part(entry, ' | ', 1)) + 4) AS purpose FROM entries WHERE contains(entry, ' | ')")
def filemap_rows(v):
    """Entries cut at the first separator."""
    rows = v.entries.where(F.col("entry").contains(" | ")).withColumn("p", F.split("entry", r" \| ", 2))
    return rows.select("doc_id", "pos", F.col("p")[0].alias("path"), F.col("p")[1].alias("purpose"))


@query("filemap_normalize", """SELECT page_id, CASE WHEN path = '/en' THEN '.' WHEN starts_with(path, '/en/') THEN substr(path, 5) ELSE path END AS path
    FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages)""")
def filemap_normalize(v):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    rows = v.table("pages").select("page_id", path.alias("path"))
    return rows.selectExpr("page_id", "case when path = '/en' then '.' when startswith(path, '/en/') then substring(path, 5) else path end path")


@query("entry_key", "SELECT doc_id, pos, 'memory:' || bucket || ':' || substr(sha256(lower(trim(regexp_replace(entry, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' '))), 1, 20) AS entry_key FROM entries")
def entry_key(v):
    return v.entries.select("doc_id", "pos", T.entry_key(F.lit("memory"), F.col("bucket"), F.col("entry")).alias("entry_key"))


@query("project_key", """SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(CASE page_id % 3 WHEN 0 THEN url || '.git' WHEN 1 THEN 'git@' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/', ':') ELSE url END,
    '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^@/]+@([^:/]+)[:/](.+)$', '\\1/\\2'), '\\.git$', '')) AS project_key FROM pages""")
def project_key(v):
    """Three spellings of an origin reduce to one key."""
    url = F.expr("case page_id % 3 when 0 then concat(url, '.git') when 1 then concat('git@', regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^([^/]*)/', '$1:')) else url end")
    return v.table("pages").select("page_id", T.project_key(url).alias("project_key"))


@query("match_status", """SELECT doc_id, CASE WHEN count(*) FILTER (contains(lower(entry), 'thtion')) = 0 THEN 'match_not_found' WHEN count(*) FILTER (contains(lower(entry), 'thtion')) = 1 THEN 'matched'
    ELSE 'match_ambiguous' END AS status FROM entries GROUP BY 1""")
def match_status(v):
    n = F.count_if(F.lower("entry").contains("thtion"))
    return v.entries.groupBy("doc_id").agg(F.when(n == 0, "match_not_found").when(n == 1, "matched").otherwise("match_ambiguous").alias("status"))


@query("memory_edit", """SELECT doc_id, pos, CASE WHEN hit AND n = 1 THEN 'replaced' ELSE entry END AS entry FROM (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY doc_id) AS n FROM (SELECT *, contains(lower(entry), 'thtion') AS hit FROM entries))""")
def memory_edit(v):
    """Replacement in every file of the only entry that holds a text; no match or several leave the file as it is."""
    hit = F.lower("entry").contains("thtion")
    n = v.entries.where(hit).groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").withColumn("one", F.lit(True)).drop("n")
    rows = v.entries.join(n, "doc_id", "left")
    return rows.select("doc_id", "pos", F.when(hit & F.col("one"), "replaced").otherwise(F.col("entry")).alias("entry"))


@query("memory_add", "SELECT doc_id, min(pos) AS pos, count(*) - 1 AS dropped FROM entries GROUP BY doc_id, lower(entry)")
def memory_add(v):
    """Adding entries one after another: the first of those that are equal without case stays."""
    rows = v.entries.groupBy("doc_id", F.lower("entry").alias("key")).agg(F.min("pos").alias("pos"), (F.count("*") - 1).alias("dropped"))
    return rows.select("doc_id", "pos", "dropped")


@query("themes", """SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9_]{3,}')))[1:5], ' ') AS themes FROM beliefs""")
def themes(v):
    return v.beliefs.select("id", F.array_join(F.slice(F.array_sort(T.overlap_tokens(F.col("claim"))), 1, 5), " ").alias("themes"))


@query("overlap_tokens", "SELECT id, len(t) AS n FROM claim_toks")
def overlap_tokens(v):
    return v.beliefs.select("id", F.size(T.overlap_tokens(F.col("claim"))).cast("long").alias("n"))


@query("dream_tokens", f"""SELECT id, len(list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')), lambda x: NOT list_contains(string_split('{" ".join(C.DREAM_STOPWORDS)}', ' '), x))) AS n FROM beliefs""")
def dream_tokens(v):
    return v.beliefs.select("id", F.size(T.dream_tokens(F.col("claim"))).cast("long").alias("n"))


@query("cluster_tokens", f"""SELECT id, len(list_filter(t, lambda x: NOT list_contains(string_split('{" ".join(C.CLUSTER_STOPWORDS)}', ' '), x))) AS n FROM claim_toks""")
def cluster_tokens(v):
    return v.beliefs.select("id", F.size(T.cluster_tokens(F.col("claim"))).cast("long").alias("n"))


@query("audit_extract", """SELECT doc_id, pos, CASE WHEN p <> '' THEN 'path' WHEN t <> '' THEN 'token' ELSE 'uncheckable' END AS kind, rtrim(CASE WHEN p <> '' THEN p ELSE t END, '.,;:') AS fragment
    FROM (SELECT doc_id, pos, regexp_extract(entry, '/[a-zA-Z0-9_./~-]+/[a-zA-Z0-9_./-]+') AS p, regexp_extract(entry, '\\b[A-Za-z_][a-zA-Z0-9_]*=[^\\s''"]+|--[a-z][a-zA-Z0-9_-]+') AS t FROM entries)""")
def audit_extract(v):
    """The first absolute path of a line, else an assignment or flag, else nothing to check."""
    rows = v.entries.select("doc_id", "pos", F.regexp_extract("entry", r"/[a-zA-Z0-9_./~-]+/[a-zA-Z0-9_./-]+", 0).alias("p"), F.regexp_extract("entry", r"\b[A-Za-z_][a-zA-Z0-9_]*=[^\s'\"]+|--[a-z][a-zA-Z0-9_-]+", 0).alias("t"))
    return rows.selectExpr("doc_id", "pos", "case when p <> '' then 'path' when t <> '' then 'token' else 'uncheckable' end kind", "rtrim('.,;:', case when p <> '' then p else t end) fragment")


@query("resolve_subject", """SELECT raw, CASE WHEN exact = 1 THEN raw WHEN n_suffix = 1 THEN suffix WHEN n_sub = 1 THEN sub END AS slug FROM (SELECT raw, count(*) FILTER (s = raw) AS exact,
    count(*) FILTER (ends_with(s, raw)) AS n_suffix, min(s) FILTER (ends_with(s, raw)) AS suffix, count(*) FILTER (contains(s, raw)) AS n_sub, min(s) FILTER (contains(s, raw)) AS sub
    FROM (SELECT DISTINCT source AS raw FROM documents UNION SELECT 'rc7' UNION SELECT '1' UNION SELECT 'none') r, (SELECT DISTINCT source AS s FROM documents) k GROUP BY raw)""")
def resolve_subject(v):
    """Exact slug, else the only suffix match, else the only substring match. The known slugs are a dimension of one row a source."""
    known = v.table("documents").select(F.col("source").alias("s")).distinct()
    raw = known.select(F.col("s").alias("raw")).union(v.spark.createDataFrame([("rc7",), ("1",), ("none",)], "raw string")).distinct()
    # An equi-join on the infixes of the known slugs, which are short names: no pair of unrelated rows meets.
    cuts = F.expr("flatten(transform(sequence(1, char_length(s)), i -> transform(sequence(1, char_length(s) - i + 1), n -> substring(s, i, n))))")
    infixes = known.select("s", F.explode(cuts).alias("raw")).distinct()
    pairs = raw.join(infixes, "raw", "left")
    tail = F.col("s").endswith(F.col("raw"))
    rows = pairs.groupBy("raw").agg(F.count_if(F.col("s") == F.col("raw")).alias("exact"), F.count_if(tail).alias("n_suffix"), F.min(F.when(tail, F.col("s"))).alias("suffix"), F.count("s").alias("n_sub"), F.min("s").alias("sub"))
    return rows.select("raw", F.when(F.col("exact") == 1, F.col("raw")).when(F.col("n_suffix") == 1, F.col("suffix")).when(F.col("n_sub") == 1, F.col("sub")).alias("slug"))
