"""Queries over the operation log, store comparison, plans, usage counters and behaviour mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone import constants as C
from loomstone.functions import text as T
from loomstone.operators import oplog as O

from .registry import query

R6 = T.rounded
CLASSES = ["session", "memory", "belief"]
ORDER = "lamport, machine_id, machine_seq"


@query("canonical_order", f"SELECT machine_id, op_id, row_number() OVER (PARTITION BY machine_id ORDER BY {ORDER}) AS place FROM log")
def canonical_order(v):
    """Place of each operation in the canonical order of its machine."""
    return v.log.select("machine_id", "op_id", F.row_number().over(Window.partitionBy("machine_id").orderBy(O.canonical())).cast("long").alias("place"))


@query("op_dedup", "SELECT op_id, seq FROM log")
def op_dedup(v):
    return v.log.select("op_id", "seq")


@query("op_slots", "SELECT machine_id, machine_seq, count(DISTINCT op_id) AS n_ops, count(*) FILTER (verified) AS n_accepted FROM log GROUP BY 1, 2")
def op_slots(v):
    return O.slots(v.log)


@query("op_admission", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY op_id ORDER BY seq) > 1 THEN 'duplicate' WHEN class NOT IN ('session', 'memory', 'belief') THEN 'unknown' WHEN NOT verified THEN 'unverified'
    WHEN k IS NULL THEN 'quarantined' ELSE 'applied' END AS state FROM ops) GROUP BY 1""")
def op_admission(v):
    return O.admission(v.ops, CLASSES).groupBy("state").agg(F.count("*").alias("n"))


@query("op_states", "SELECT class, count(*) FILTER (verified) AS accepted, count(*) FILTER (NOT verified) AS unverified FROM log GROUP BY 1")
def op_states(v):
    return v.log.groupBy("class").agg(F.count_if("verified").alias("accepted"), F.count_if(~F.col("verified")).alias("unverified"))


@query("quarantined_ops", "SELECT op_id FROM log WHERE class = 'belief' AND (k IS NULL OR k % 25 = 0)")
def quarantined_ops(v):
    """Belief operations without a usable reference; every 25th key stands in for a missing one."""
    return v.log.where("class = 'belief' and (k is null or k % 25 = 0)").select("op_id")


@query("ops_page", "SELECT seq, op_id FROM (SELECT * FROM ops WHERE seq > 100 ORDER BY seq LIMIT 500) WHERE machine_id <> 'm2'")
def ops_page(v):
    """Keyset page: the author is excluded after paging."""
    return v.ops.where("seq > 100").orderBy("seq").limit(C.PAGE).where("machine_id <> 'm2'").select("seq", "op_id")


@query("pending_page", "SELECT event_id, op_id FROM log WHERE event_id > 50 ORDER BY event_id LIMIT 100")
def pending_page(v):
    return v.log.where("event_id > 50").orderBy("event_id").limit(100).select("event_id", "op_id")


@query("op_gaps", """SELECT machine_id, machine_seq - (gap - 1) AS first_missing, machine_seq - 1 AS last_missing FROM (SELECT machine_id, machine_seq, machine_seq - lag(machine_seq, 1, 0) OVER (PARTITION BY machine_id ORDER BY machine_seq) AS gap FROM accepted) WHERE gap > 1""")
def op_gaps(v):
    return O.gaps(v.accepted)


@query("unpushed", "SELECT machine_id, count(*) AS n FROM log WHERE seq > 500 GROUP BY 1")
def unpushed(v):
    return v.log.where("seq > 500").groupBy("machine_id").agg(F.count("*").alias("n"))


def lww(cls: str, key: str) -> str:
    return f"SELECT {key}, op_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY lamport DESC, machine_id DESC, machine_seq DESC) AS rn FROM accepted WHERE class = '{cls}') WHERE rn = 1"


@query("session_lww", lww("session", "k"))
def session_lww(v):
    return O.last_writer(v.accepted.where("class = 'session'"), ["k"], ["op_id", "payload"])


@query("skill_lww", lww("skill", "k"))
def skill_lww(v):
    return O.last_writer(v.accepted.where("class = 'skill'"), ["k"], ["op_id", "payload"])


@query("skill_merge", """SELECT k, op_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lamport DESC, machine_id DESC, machine_seq DESC) AS rn FROM accepted WHERE class = 'skill') WHERE rn = 1 AND event_id % 6 <> 0""")
def skill_merge(v):
    """Puts and removals (every sixth): the last one decides."""
    ops = v.accepted.where("class = 'skill'").withColumn("op", F.when(F.col("event_id") % 6 == 0, "remove").otherwise("put"))
    return O.put_or_remove(ops, ["k"], ["op_id"])


@query("remote_lww", "SELECT class, project_key, machine_id, arg_max(op_id, lamport * 1000000 + machine_seq) AS op_id FROM accepted GROUP BY 1, 2, 3")
def remote_lww(v):
    return O.last_writer(v.accepted, ["class", "project_key", "machine_id"], ["op_id"])


@query("supersede_first", f"SELECT k, op_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {ORDER}) AS rn FROM accepted WHERE class = 'belief' AND op = 'supersede') WHERE rn = 1")
def supersede_first(v):
    return O.first_writer(v.accepted.where("class = 'belief' and op = 'supersede'"), ["k"], ["op_id"])


@query("belief_replay", f"""WITH i AS (SELECT k, op_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {ORDER}) AS rn FROM accepted WHERE class = 'belief' AND op = 'insert') WHERE rn = 1),
    s AS (SELECT k, op_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {ORDER}) AS rn FROM accepted WHERE class = 'belief' AND op = 'supersede') WHERE rn = 1),
    r AS (SELECT k, count(*) - 1 AS n FROM accepted WHERE class = 'belief' AND op = 'insert' GROUP BY 1)
    SELECT i.k, i.op_id AS inserted_by, r.n AS reinforced, s.op_id AS superseded_by, CASE WHEN s.op_id IS NULL THEN 'active' ELSE 'superseded' END AS status FROM i JOIN r USING (k) LEFT JOIN s USING (k)""")
def belief_replay(v):
    """A store is a function of its log: first insert per key, later equal inserts reinforce, the first supersede wins."""
    ops = v.accepted.where("class = 'belief'")
    first = O.first_writer(ops.where("op = 'insert'"), ["k"], ["op_id"]).withColumnRenamed("op_id", "inserted_by")
    more = ops.where("op = 'insert'").groupBy("k").agg((F.count("*") - 1).alias("reinforced"))
    gone = O.first_writer(ops.where("op = 'supersede'"), ["k"], ["op_id"]).withColumnRenamed("op_id", "superseded_by")
    return first.join(more, "k").join(gone, "k", "left").withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))


@query("deferred_ops", """WITH RECURSIVE s AS (SELECT op_id, event_id AS uid, event_id - 7 AS ref FROM accepted WHERE class = 'belief' AND op = 'supersede'),
    k(uid) AS (SELECT event_id FROM accepted WHERE class = 'belief' AND op = 'insert' UNION SELECT s.uid FROM s JOIN k ON s.ref = k.uid) SELECT op_id FROM s WHERE ref NOT IN (SELECT uid FROM k)""")
def deferred_ops(v):
    """Every supersede refers to the operation seven events earlier, an insert or a supersede that may wait itself."""
    own = v.accepted.where("class = 'belief'")
    ops = own.where("op = 'supersede'").selectExpr("op_id", "event_id uid", "event_id - 7 ref")
    return O.deferred(ops, own.where("op = 'insert'").selectExpr("event_id uid")).select("op_id")


@query("replace_conflicts", "SELECT k, lamport, count(DISTINCT machine_id) AS n_machines, min(payload) AS a_text, max(payload) AS b_text FROM (SELECT * REPLACE (lamport // 200 AS lamport) FROM accepted WHERE class = 'memory') GROUP BY 1, 2 HAVING count(DISTINCT machine_id) > 1")
def replace_conflicts(v):
    """Replacements of one key in the same epoch (200 ticks) by different machines."""
    return O.replace_conflicts(v.accepted.where("class = 'memory'").withColumn("lamport", F.expr("lamport div 200")), ["k"])


@query("open_conflicts", """SELECT k, lamport FROM (SELECT k, lamport, min(op_id) AS a, max(op_id) AS b FROM (SELECT * REPLACE (lamport // 200 AS lamport) FROM accepted WHERE class = 'memory') GROUP BY 1, 2 HAVING count(DISTINCT machine_id) > 1)
    WHERE a IN (SELECT op_id FROM accepted WHERE event_id % 2 = 0) AND b IN (SELECT op_id FROM accepted WHERE event_id % 2 = 0)""")
def open_conflicts(v):
    """A pair stays listed while both of its texts exist; half of the texts have gone here."""
    ops = v.accepted.where("class = 'memory'").withColumn("lamport", F.expr("lamport div 200"))
    pairs = ops.groupBy("k", "lamport").agg(F.countDistinct("machine_id").alias("n"), F.min("op_id").alias("a"), F.max("op_id").alias("b")).where("n > 1")
    alive = v.accepted.where("event_id % 2 = 0").select("op_id")
    return pairs.join(alive.withColumnRenamed("op_id", "a"), "a", "left_semi").join(alive.withColumnRenamed("op_id", "b"), "b", "left_semi").select("k", "lamport")


CHUNKS = "SELECT 'c' || k AS session_id, machine_seq % 40 AS from_line, machine_seq % 40 + k % 7 + 1 AS to_line FROM accepted WHERE class = 'session' AND k IS NOT NULL"


@query("chunk_prefix", f"""WITH c AS (SELECT session_id, from_line, to_line, coalesce(max(to_line) OVER (PARTITION BY session_id ORDER BY from_line, to_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM ({CHUNKS})),
    b AS (SELECT *, max(CASE WHEN from_line > held + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY from_line, to_line) AS broken FROM c)
    SELECT session_id, coalesce(max(to_line) FILTER (broken = 0), 0) AS lines_held, CAST(sum(broken) AS BIGINT) AS chunks_waiting FROM b GROUP BY 1""")
def chunk_prefix(v):
    chunks = v.accepted.where("class = 'session' and k is not null").selectExpr("concat('c', k) session_id", "machine_seq % 40 from_line", "machine_seq % 40 + k % 7 + 1 to_line")
    return O.contiguous_prefix(chunks)


@query("pending_state", f"""SELECT s.k, s.op_id AS staged_by, r.op_id AS resolved_by FROM (SELECT k, op_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {ORDER}) AS rn FROM accepted WHERE class = 'memory') WHERE rn = 1) s
    LEFT JOIN (SELECT k, op_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {ORDER}) AS rn FROM accepted WHERE class = 'skill') WHERE rn = 1) r USING (k)""")
def pending_state(v):
    """Staging a known uid and resolving an unknown one change nothing: first stage, first resolution."""
    stage = O.first_writer(v.accepted.where("class = 'memory'"), ["k"], ["op_id"]).withColumnRenamed("op_id", "staged_by")
    done = O.first_writer(v.accepted.where("class = 'skill'"), ["k"], ["op_id"]).withColumnRenamed("op_id", "resolved_by")
    return stage.join(done, "k", "left")


@query("seed_plan", "SELECT DISTINCT k FROM log WHERE class = 'session' AND k NOT IN (SELECT k FROM accepted WHERE class = 'session' AND lamport < 100)")
def seed_plan(v):
    """What the log up to a point can't reproduce of the store."""
    return v.log.where("class = 'session'").select("k").distinct().join(v.accepted.where("class = 'session' and lamport < 100").select("k"), "k", "left_anti")


@query("pending_kinds", "SELECT class AS kind, count(*) AS n FROM log WHERE NOT verified GROUP BY 1")
def pending_kinds(v):
    return v.log.where("not verified").groupBy(F.col("class").alias("kind")).agg(F.count("*").alias("n"))


@query("pending_by_session", """SELECT s.session_id, count(p.op_id) AS n, NOT EXISTS (SELECT 1 FROM log x WHERE NOT verified AND k IS NULL) AS complete FROM sessions s LEFT JOIN log p ON s.session_id = 's' || p.k AND NOT p.verified GROUP BY 1""")
def pending_by_session(v):
    """Proposals of each session; complete is false when any proposal without a session could belong to it."""
    waiting = v.log.where("not verified").select(F.expr("concat('s', k)").alias("session_id"), "op_id")
    loose = waiting.agg((F.count_if(F.col("session_id").isNull()) == 0).alias("complete"))
    n = waiting.groupBy("session_id").agg(F.count("op_id").alias("n"))
    return v.sessions.select("session_id").join(n, "session_id", "left").fillna(0, subset=["n"]).crossJoin(F.broadcast(loose))


# Store comparison

LEFT, RIGHT = "SELECT subject, status, confidence FROM beliefs WHERE id % 3 <> 0", "SELECT subject, status, confidence FROM beliefs WHERE id % 4 <> 0"


def sides(v):
    cols = ["subject", "status", "confidence"]
    return v.beliefs.where("id % 3 <> 0").select(*cols), v.beliefs.where("id % 4 <> 0").select(*cols)


@query("store_diff", f"""SELECT (SELECT count(*) FROM ({LEFT} INTERSECT ALL {RIGHT})) AS common_count, (SELECT count(*) FROM ({LEFT} EXCEPT ALL {RIGHT})) AS source_only, (SELECT count(*) FROM ({RIGHT} EXCEPT ALL {LEFT})) AS destination_only""")
def store_diff(v):
    """Multiset comparison of two stores in one pass: counts per row on either side."""
    a, b = sides(v)
    both = a.withColumn("x", F.lit(1)).withColumn("y", F.lit(0)).unionByName(b.withColumn("x", F.lit(0)).withColumn("y", F.lit(1)))
    n = both.groupBy("subject", "status", "confidence").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    zero = F.lit(0).cast("long")
    return n.agg(*(F.coalesce(F.sum(c), zero).alias(k) for k, c in (("common_count", F.least("x", "y")), ("source_only", F.greatest(F.col("x") - F.col("y"), zero)), ("destination_only", F.greatest(F.col("y") - F.col("x"), zero)))))


@query("distinct_rows", "SELECT DISTINCT subject, status FROM beliefs")
def distinct_rows(v):
    return v.beliefs.select("subject", "status").distinct()


@query("field_diff", f"""SELECT 'status' AS field, (SELECT count(*) FROM ((SELECT subject, status FROM ({LEFT})) EXCEPT ALL (SELECT subject, status FROM ({RIGHT})))) AS n
    UNION ALL SELECT 'confidence', (SELECT count(*) FROM ((SELECT subject, confidence FROM ({LEFT})) EXCEPT ALL (SELECT subject, confidence FROM ({RIGHT}))))""")
def field_diff(v):
    a, b = sides(v)
    rows = [a.select("subject", f).exceptAll(b.select("subject", f)).agg(F.lit(f).alias("field"), F.count("*").alias("n")) for f in ("status", "confidence")]
    return rows[0].unionByName(rows[1])


# Plans


@query("retention_plan", """SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'referenced' WHEN age < 0 THEN 'kept' WHEN age >= 24 AND (age > 720 OR place >= 1000) THEN 'remove' ELSE 'kept' END AS decision FROM
    (SELECT event_id, date_diff('hour', date_trunc('hour', ts), TIMESTAMP '2024-01-29') AS age, row_number() OVER (PARTITION BY event_id % 9 = 0 ORDER BY ts DESC, event_id DESC) - 1 AS place FROM events)""")
def retention_plan(v):
    """Newest first; referenced ones are exempt and not ranked; nothing younger than a day goes, future ones stay.

    Only the place of the 1000th newest matters, so the rank is a comparison with that row's key, not a global window."""
    rows = v.table("events").select(F.col("event_id").alias("id"), "ts", (F.col("event_id") % 9 == 0).alias("referenced"))
    key = F.struct("ts", "id")
    edge = rows.where("not referenced").orderBy(F.desc("ts"), F.desc("id")).limit(C.RETENTION_COUNT).agg(F.min(key).alias("edge"), F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(edge)).withColumn("age", F.expr("timestampdiff(HOUR, date_trunc('hour', ts), timestamp_ntz'2024-01-29 00:00:00')"))
    late = (F.col("n") >= C.RETENTION_COUNT) & (key < F.col("edge"))
    old = (F.col("age") >= C.RETENTION_HOURS) & ((F.col("age") > C.RETENTION_DAYS * 24) | late)
    return rows.select("id", F.when(F.col("referenced"), "referenced").when(F.col("age") < 0, "kept").when(old, "remove").otherwise("kept").alias("decision"))


@query("snapshot_stale", "SELECT a.doc_id FROM documents a LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) s ON s.h = sha256(a.text) WHERE s.h IS NULL AND a.text IS NOT NULL")
def snapshot_stale(v):
    """Snapshots whose source hash is no longer known."""
    docs = v.table("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(docs.where("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("refresh_changes", "SELECT bucket, doc_id FROM (SELECT bucket, doc_id, h, lag(h) OVER (PARTITION BY bucket ORDER BY doc_id) AS before FROM (SELECT source AS bucket, doc_id, sha256(coalesce(text, '')) AS h FROM documents)) WHERE before IS NULL OR before <> h")
def refresh_changes(v):
    """Renderings that differ from the one before them in the same bucket."""
    rows = v.table("documents").select(F.col("source").alias("bucket"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    rows = rows.withColumn("before", F.lag("h").over(Window.partitionBy("bucket").orderBy("doc_id")))
    return rows.where("before is null or before <> h").select("bucket", "doc_id")


@query("doctor_counts", """SELECT (SELECT count(*) FROM evidence WHERE belief_id NOT IN (SELECT id FROM beliefs)) AS orphan_evidence, (SELECT count(*) FROM beliefs WHERE superseded_by = id) AS self_superseded,
    (SELECT count(*) FROM log WHERE NOT verified) AS unverified, (SELECT count(*) FROM edges WHERE src = dst) AS self_edges""")
def doctor_counts(v):
    orphan = v.evidence.join(v.beliefs.select(F.col("id").alias("belief_id")), "belief_id", "left_anti").agg(F.count("*").alias("orphan_evidence"))
    rest = [v.beliefs.agg(F.count_if(F.col("superseded_by") == F.col("id")).alias("self_superseded")), v.log.agg(F.count_if(~F.col("verified")).alias("unverified")), v.edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_edges"))]
    for r in rest:
        orphan = orphan.crossJoin(r)
    return orphan


# Usage counters and mining


@query("usage_crdt", """SELECT name, CAST(sum(uses) AS BIGINT) AS uses, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(fail) AS BIGINT) AS fail FROM (SELECT name, origin, max(uses) AS uses, max(ok) AS ok, max(fail) AS fail FROM
    (SELECT *, max(generation) OVER (PARTITION BY name, origin) AS top FROM usage) WHERE generation = top GROUP BY 1, 2) GROUP BY 1""")
def usage_crdt(v):
    """The highest generation of each origin wins, equal generations take the greater of each field; origins add up."""
    top = v.usage.groupBy("name", "origin").agg(F.max(F.struct("generation")).alias("g"))
    rows = v.usage.join(top, ["name", "origin"]).where("generation = g.generation").groupBy("name", "origin").agg(*(F.max(c).alias(c) for c in ("uses", "ok", "fail")))
    return rows.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("uses", "ok", "fail")))


@query("skill_record", "SELECT name, sum(uses)::BIGINT || ' uses, ' || sum(ok)::BIGINT || ' ok' || CASE WHEN sum(fail) > 0 THEN ', ' || sum(fail)::BIGINT || ' failed' ELSE '' END AS record FROM usage GROUP BY 1")
def skill_record(v):
    n = v.usage.groupBy("name").agg(F.sum("uses").alias("u"), F.sum("ok").alias("o"), F.sum("fail").alias("f"))
    return n.selectExpr("name", "concat(u, ' uses, ', o, ' ok', case when f > 0 then concat(', ', f, ' failed') else '' end) record")


@query("skill_gate", """SELECT name, n, last_event, CASE WHEN n >= 3 THEN 'retire' WHEN n >= 2 OR (n >= 1 AND last_event = 'error') THEN 'update' ELSE 'none' END AS admitted
    FROM (SELECT user_id AS name, count(*) FILTER (event_type IN ('purchase', 'error')) AS n, arg_max(event_type, event_id) AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 10 GROUP BY 1)""")
def skill_gate(v):
    """Last ten outcomes of each skill; an update needs two, one after a hard failure, retiring needs three."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = v.table("events").withColumn("back", F.row_number().over(w)).where("back <= 10").groupBy(F.col("user_id").alias("name"))
    rows = rows.agg(F.count_if(F.col("event_type").isin("purchase", "error")).alias("n"), F.max_by("event_type", "event_id").alias("last_event"))
    return rows.withColumn("admitted", F.when(F.col("n") >= 3, "retire").when((F.col("n") >= 2) | ((F.col("n") >= 1) & (F.col("last_event") == "error")), "update").otherwise("none"))


@query("skill_catalog", "SELECT doc_id, regexp_extract(text, '(?m)^(The [^\\n]*)$', 1) AS description FROM documents WHERE contains(substr(text, 1, 600), 'The')")
def skill_catalog(v):
    """Files whose first 600 characters hold the marker (the marker's own limit), with their description line."""
    rows = v.table("documents").where(F.substring("text", 1, 600).contains("The"))
    return rows.select("doc_id", F.regexp_extract("text", r"(?m)(?-s)^(The [^\n]*)$", 1).alias("description"))


@query("skill_quality", """SELECT doc_id, strlen(text) <= 16384 AS small_enough, NOT (strlen(text) > 2 * base AND strlen(text) > base + 4096) AS not_bloated, NOT contains(lower(text), 'thtion the') AS no_answer
    FROM (SELECT doc_id, text, 2000 AS base FROM documents) WHERE text IS NOT NULL""")
def skill_quality(v):
    size = F.octet_length("text")
    rows = v.table("documents").where("text is not null")
    return rows.select("doc_id", (size <= 16384).alias("small_enough"), (~((size > 4000) & (size > 2000 + 4096))).alias("not_bloated"), (~F.lower("text").contains("thtion the")).alias("no_answer"))


# Phrases by which people correct an agent.
CORRECTION = r"(?:^no\b[,.! ]|\bnot what i (?:asked|meant|said|wanted)|\bi (?:already )?told you|\bas i said|\bi said\b|\byou ignored|\byou didn'?t (?:read|listen|do|follow)|\bwhy did you|\bthat'?s (?:still )?wrong|\bstill (?:wrong|broken|failing)|\bundo (?:that|this)|\brevert (?:that|this)|\bdon'?t do that|\bstop\b[,.! ]|\bfalsch\b)"
#: The test texts hold no corrections, so a second lexicon stands in for them.
STAND_IN = r"(?:\bthe a|\bund der\b|^ou |\bque la\b)"


@query("mine_corrections", f"SELECT session_id, rowid, regexp_matches(content, '(?i){CORRECTION.replace(chr(39), chr(39) * 2)}') AS correction, regexp_matches(content, '(?i){STAND_IN}') AS stand_in FROM msg WHERE role = 'user'")
def mine_corrections(v):
    rows = v.msg.where("role = 'user'")
    return rows.select("session_id", "rowid", T.matches(F.col("content"), CORRECTION).alias("correction"), T.matches(F.col("content"), STAND_IN).alias("stand_in"))


@query("mine_daily", f"SELECT substr(ts, 1, 10) AS day, count(DISTINCT session_id) AS sessions, count(*) AS user_msgs, count(*) FILTER (regexp_matches(content, '(?i){STAND_IN}')) AS corrections FROM msg WHERE role = 'user' GROUP BY 1")
def mine_daily(v):
    rows = v.msg.where("role = 'user'").groupBy(F.substring("ts", 1, 10).alias("day"))
    return rows.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("user_msgs"), F.count_if(T.matches(F.col("content"), STAND_IN)).alias("corrections"))


@query("mine_zscore", f"""WITH p AS (SELECT count(*) FILTER (post = 0)::DOUBLE AS n1, count(*) FILTER (post = 1)::DOUBLE AS n2, count(*) FILTER (post = 0 AND c)::DOUBLE AS c1, count(*) FILTER (post = 1 AND c)::DOUBLE AS c2
    FROM (SELECT CASE WHEN ts >= '2024-01-01T10:00:00Z' THEN 1 ELSE 0 END AS post, regexp_matches(content, '(?i){STAND_IN}') AS c FROM msg WHERE role = 'user'))
    SELECT n1, n2, c1, c2, round(CASE WHEN n1 > 0 AND n2 > 0 AND (c1 + c2) > 0 THEN (c1 / n1 - c2 / n2) / sqrt((c1 + c2) / (n1 + n2) * (1 - (c1 + c2) / (n1 + n2)) * (1 / n1 + 1 / n2)) ELSE 0 END, 6) AS z FROM p""")
def mine_zscore(v):
    """Two-proportion z-score of the correction rate before and after a boundary."""
    rows = v.msg.where("role = 'user'").select((F.col("ts") >= "2024-01-01T10:00:00Z").alias("post"), T.matches(F.col("content"), STAND_IN).alias("c"))
    d = lambda cond: F.count_if(cond).cast("double")
    n = rows.agg(d(~F.col("post")).alias("n1"), d(F.col("post")).alias("n2"), d(~F.col("post") & F.col("c")).alias("c1"), d(F.col("post") & F.col("c")).alias("c2"))
    z = "case when n1 > 0 and n2 > 0 and c1 + c2 > 0 then (c1 / n1 - c2 / n2) / sqrt((c1 + c2) / (n1 + n2) * (1 - (c1 + c2) / (n1 + n2)) * (1 / n1 + 1 / n2)) else 0D end"
    return n.selectExpr("n1", "n2", "c1", "c2", f"round({z}, 6) z")
